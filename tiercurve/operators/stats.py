"""Distribution statistics of spending and purchase spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiercurve.functions.text import thousands_text
from tiercurve.operators.quantiles import (
    COUNT,
    KEY,
    counted_points,
    placed_steps,
    quantiles,
    quantiles_of_steps,
    without_key,
)
from tiercurve.operators.running import POINT, STEP

AMOUNT_STEP = 1000
QUARTILES = {"q1": 0.25, "med": 0.5, "q3": 0.75}


def purchase_span_histogram(lifetime: DataFrame, width: int = 50) -> DataFrame:
    """Customers per span bin and order count.

    Bins are centred on multiples of ``width`` and closed on the right; empty bins are absent.
    """
    ahead = F.ceil((F.col("diff_days") - F.lit(width / 2)) / F.lit(float(width)))
    center = (F.greatest(ahead, F.lit(0)) * width).cast("int")
    return (
        lifetime.where(F.col("diff_days").isNotNull())
        .groupBy(center.alias("bin_center"), "cnt_ord")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def box_stats(
    df: DataFrame, keys: Sequence[str], value: str, width: float = AMOUNT_STEP
) -> DataFrame:
    """Quartiles, whiskers and outlier count of ``value`` per group of ``keys``.

    Outliers lie more than 1.5 interquartile ranges outside the box. A whisker ends at the
    most extreme other value, or at the box where that value lies inside the box. A NULL key is
    a group like any other.
    """
    points = counted_points(df, keys, value, width)
    placed = placed_steps(points)
    box = quantiles_of_steps(points, placed, QUARTILES)
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    fenced = placed.drop("n", "mean").join(box, KEY).withColumns({"_from": F.col("q1") - reach, "_to": F.col("q3") + reach})

    def inside(least, most):
        return (least >= F.col("_from")) & (most <= F.col("_to"))

    # A step lies inside the fences or outside them as a whole, but for those that hold a fence: only
    # their values are read again.
    split = (F.col("_low") < F.col("_from")) & (F.col("_high") >= F.col("_from")) | (F.col("_low") <= F.col("_to")) & (F.col("_high") > F.col("_to"))
    steps = fenced.select(KEY, F.col(STEP).alias("_at"), F.col(COUNT).alias("_all"), "n", *QUARTILES, "_low", "_high", "_from", "_to", split.alias("_split"))
    again = points.where(F.col(COUNT) > 0).select(F.col(KEY).alias("_of"), STEP, F.col(POINT).alias("_x"), COUNT)
    cells = steps.join(again, (F.col(KEY) == F.col("_of")) & (F.col("_at") == F.col(STEP)) & F.col("_split"), "left")
    low, high = F.coalesce("_x", "_low"), F.coalesce("_x", "_high")
    kept = inside(low, high)
    stats = (
        cells.groupBy(KEY)
        .agg(
            *(F.max(c).alias(c) for c in ("n", *QUARTILES)),
            F.min(F.when(kept, low)).alias("lo"),
            F.max(F.when(kept, high)).alias("hi"),
            F.sum(F.when(kept, 0).otherwise(F.coalesce(F.col(COUNT), F.col("_all")))).alias("n_out"),
        )
        .withColumn("lo", F.least("lo", "q1"))
        .withColumn("hi", F.greatest("hi", "q3"))
    )
    return without_key(stats, keys)


def amount_box_stats(summary: DataFrame) -> DataFrame:
    """Box statistics of the amount per order count."""
    return box_stats(summary, ["cnt_order"], "sum_amt")


def monthly_box_stats(his: DataFrame, exclude_ym: str = "2020-01") -> DataFrame:
    """Box statistics of the amount, in thousands, per month and order count."""
    stats = box_stats(
        his.where(F.col("std_ym") != exclude_ym), ["std_ym", "cnt_order"], "sum_amt"
    )
    # Scaled at the end: dividing every amount first would move values across a quartile tie.
    scaled = ("q1", "med", "q3", "lo", "hi")
    return stats.withColumns({c: F.round(F.col(c), 4) / 1000 for c in scaled})


def median_amount_by_orders(summary: DataFrame) -> DataFrame:
    """Median amount per order count and its label in thousands."""
    medians = quantiles(summary, ["cnt_order"], "sum_amt", {"med": 0.5}, AMOUNT_STEP)
    return medians.select("cnt_order", "med", thousands_text(F.col("med")).alias("label"))
