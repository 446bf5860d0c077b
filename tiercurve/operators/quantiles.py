"""Exact quantiles without collecting a group into one task, by two passes over counted values.

Values are counted by key and value first, map-side. The totals of steps of fixed width (``running.with_steps``) tell
in which step each wanted rank lies; only the values of those steps are read again and ranked, each step on its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiercurve.operators.running import BELOW_ALL, POINT, STEP, with_steps

COUNT, KEY = "_n", "_key"


def counted_points(
    df: DataFrame, keys: Sequence[str], value: str, width: float, weight: str | None = None
) -> DataFrame:
    """Distinct values per key with their step and number of rows (or sum of ``weight``), placed by key and step.

    The keys become one struct ``_key``, which is never NULL itself: joins on it keep NULL keys, as groupings
    do. Values become 8-byte floats. Choose ``width`` so that a step holds at most some 100,000 distinct
    values. NULL counts 0.
    """
    rows = F.lit(1) if weight is None else F.col(weight)
    counted = F.sum(F.when(F.col(value).isNotNull(), rows).otherwise(0))
    # Without keys there is one group; it is made from the value, so that the plan has a key to join on.
    key = F.struct(*keys) if keys else F.struct(F.pmod(F.xxhash64(value), F.lit(1)).alias("_all"))
    x = F.col(value).cast("double")
    counts = df.groupBy(key.alias(KEY), x.alias("_x")).agg(counted.alias(COUNT))
    return with_steps(counts, "_x", width, BELOW_ALL).select(KEY, STEP, POINT, COUNT).repartition(KEY, STEP)


def placed_steps(points: DataFrame) -> DataFrame:
    """For each key and step: its values' number, sum, least and greatest; how many come before, and the key's totals."""
    x = F.when(F.col(COUNT) > 0, F.col(POINT))
    steps = points.groupBy(KEY, STEP).agg(
        F.sum(COUNT).alias(COUNT), F.sum(x * F.col(COUNT)).alias("_sum"), F.min(x).alias("_low"), F.max(x).alias("_high")
    )
    group = Window.partitionBy(KEY)
    earlier = group.orderBy(STEP).rowsBetween(Window.unboundedPreceding, -1)
    return steps.where(F.col(COUNT) > 0).select(
        "*",
        F.coalesce(F.sum(COUNT).over(earlier), F.lit(0)).alias("_before"),
        F.sum(COUNT).over(group).alias("n"),
        (F.sum("_sum").over(group) / F.sum(COUNT).over(group)).alias("mean"),
    )


def quantiles_of_steps(points: DataFrame, placed: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per ``_key``, one output column per entry of ``probs``, with ``n`` and ``mean``.

    ``placed`` are the ``placed_steps`` of ``points``. Groups without any value are absent.
    """

    def ranks(p: float) -> tuple[Column, Column]:
        at = (F.col("n") - 1) * F.lit(p)
        return F.floor(at), F.ceil(at)

    def holds(rank: Column) -> Column:
        return (F.col("_before") <= rank) & (rank < F.col("_before") + F.col(COUNT))

    wanted = F.lit(False)
    for p in probs.values():
        for rank in ranks(p):
            wanted |= holds(rank)
    bounds = placed.where(wanted).select(KEY, STEP, "_before", "n", "mean")
    upto = Window.partitionBy(KEY, STEP).orderBy(POINT).rowsBetween(Window.unboundedPreceding, -1)
    within = points.join(bounds, [KEY, STEP])
    ranked = within.withColumn("_before", F.col("_before") + F.coalesce(F.sum(COUNT).over(upto), F.lit(0)))

    def at(rank: Column) -> Column:
        return F.max(F.when(holds(rank), F.col(POINT)))

    picked = ranked.groupBy(KEY).agg(
        F.max("n").alias("n"),
        F.max("mean").alias("mean"),
        *(at(rank).alias(f"_{side}_{name}") for name, p in probs.items() for side, rank in zip(("lo", "hi"), ranks(p), strict=True)),
    )

    def between(name: str, p: float) -> Column:
        part = (F.col("n") - 1) * F.lit(p)
        part = part - F.floor(part)
        return F.col(f"_lo_{name}") * (1 - part) + F.col(f"_hi_{name}") * part

    return picked.select(KEY, "n", "mean", *(between(name, p).alias(name) for name, p in probs.items()))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    width: float,
    weight: str | None = None,
) -> DataFrame:
    """Quantiles of ``value`` per group of ``keys`` (a NULL key is a group like any other), with ``n`` and ``mean``."""
    points = counted_points(df, keys, value, width, weight)
    return without_key(quantiles_of_steps(points, placed_steps(points), probs), keys)


def without_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns of ``keys`` in place of the struct."""
    return df.select(*(F.col(KEY).getField(k).alias(k) for k in keys), *(c for c in df.columns if c != KEY))


def medians(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], width: float, weight: str | None = None
) -> DataFrame:
    """Number, mean and median of several columns side by side: ``n_<value>``, ``mean_<value>``, ``med_<value>``.

    Each row becomes one row per column, so ``df`` is read once for all. Without keys there is
    always one row.
    """
    pairs = F.array(*(F.struct(F.lit(v).alias("_which"), F.col(v).cast("double").alias("_value")) for v in values))
    weights = [weight] if weight else []
    long = df.select(*keys, *weights, F.inline(pairs))
    found = quantiles(long, [*keys, "_which"], "_value", {"med": 0.5}, width, weight)
    return found.groupBy(*keys).agg(
        *(
            F.max(F.when(F.col("_which") == v, F.col(stat))).alias(f"{stat}_{v}")
            for v in values
            for stat in ("n", "mean", "med")
        )
    )
