"""Yearly curves of cumulative customers against cumulative revenue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiercurve.operators.running import ABOVE_ALL, POINT, STEP, running_totals, with_steps
from tiercurve.operators.skew import hot_join
from tiercurve.operators.stats import AMOUNT_STEP
from tiercurve.schemas import MONEY_SUM


def pareto_curve(tx: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Per year and customer: share of customers and revenue, and both running by revenue.

    Customers with equal revenue share one running value. Returns are included, so a running
    revenue share may exceed 1. A customer without any amount comes first and has no revenue
    share. ``years`` restricts the result and lets the scan skip other dates.
    """
    dated = tx.where(F.col("tran_date").isNotNull())
    if years is not None:
        first, last = f"{min(years):04d}-01-01", f"{max(years):04d}-12-31"
        dated = dated.where(
            F.col("tran_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
            & F.year("tran_date").isin(list(years))
        )
    yearly = dated.groupBy("customer_id", F.year("tran_date").alias("yyyy")).agg(
        F.sum("total_amt").cast(MONEY_SUM).alias("sum_amt")
    )
    customers = with_steps(yearly, "sum_amt", AMOUNT_STEP, ABOVE_ALL)
    # Equal amounts are one row each; the row without a customer runs along but is not a customer.
    keys = ["yyyy", STEP, POINT]
    peers = customers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count("customer_id").alias("cust"), F.sum("sum_amt").alias("amt")
    )
    totals = running_totals(peers, ["yyyy"], ["rows", "cust", "amt"], "desc")
    running = totals.select(*keys, "rows", "rows_run", "cust_all", "amt_run", "amt_all")
    placed = hot_join(customers, running, keys, "rows", ["customer_id"])
    tot_cust = F.col("cust_all").cast("double")
    tot_amt = F.col("amt_all").cast("double")
    return placed.select(
        "yyyy",
        "customer_id",
        (1 / tot_cust).alias("cust_prop"),
        (F.col("rows_run") / tot_cust).alias("acc_cust_prop"),
        (F.col("sum_amt").cast("double") / tot_amt).alias("amt_prop"),
        (F.col("amt_run").cast("double") / tot_amt).alias("acc_amt_prop"),
    )


def pareto_year(curve: DataFrame, yyyy: int) -> DataFrame:
    """The curve of one year."""
    return curve.where(F.col("yyyy") == yyyy).select("customer_id", "acc_cust_prop", "acc_amt_prop")


def pareto_compare(
    curve: DataFrame,
    years: Sequence[int],
    x_max: float | None = None,
    y_max: float | None = None,
) -> DataFrame:
    """The curves of several years with the line of equal revenue, optionally zoomed."""
    points = curve.where(F.col("yyyy").isin(list(years))).select(
        "yyyy", "acc_cust_prop", "acc_amt_prop", F.col("acc_cust_prop").alias("equal_share")
    )
    if x_max is not None:
        points = points.where(F.col("acc_cust_prop") <= x_max)
    if y_max is not None:
        points = points.where(F.col("acc_amt_prop") <= y_max)
    return points
