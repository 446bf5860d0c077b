"""Net orders and the customer summaries made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiercurve.functions.months import month_number, month_number_of, month_text
from tiercurve.operators.quantiles import medians
from tiercurve.schemas import MONEY_SUM


def net_orders(tx: DataFrame, *grain: str, within: Column | None = None) -> DataFrame:
    """Lines of transactions without any return line, summed per transaction and customer.

    One line with ``qty < 0`` drops the whole transaction; lines without a transaction id
    are kept. Returns are marked as the lines are summed, which alone drops what a customer returned
    of their own transaction. What is left to look up are transactions of several customers (or
    several values of ``grain``) with a return among them: at most one row for each transaction, and
    none where transactions are not shared. ``grain`` adds grouping columns. ``within`` restricts the
    lines that are summed, but not those looked at for returns.
    """
    counted = F.lit(True) if within is None else F.coalesce(within, F.lit(False))
    groups = tx.groupBy("transaction_id", "customer_id", *grain).agg(
        F.sum(F.when(counted, F.col("total_amt"))).alias("sum_amt"),
        F.min(F.when(counted, F.col("tran_date"))).alias("fst_dt"),
        F.max(F.when(counted, F.col("tran_date"))).alias("lst_dt"),
        F.max(counted).alias("_counted"),
        F.max(F.coalesce(F.col("qty") < 0, F.lit(False)) & F.col("transaction_id").isNotNull()).alias("_returned"),
    )
    shared = (
        groups.where(F.col("transaction_id").isNotNull())
        .groupBy("transaction_id")
        .agg(F.max("_returned").alias("_returned"), F.count(F.lit(1)).alias("_groups"))
        .where(F.col("_returned") & (F.col("_groups") > 1))
        .select("transaction_id")
    )
    kept = groups.where(F.col("_counted") & ~F.col("_returned")).drop("_counted", "_returned")
    return kept.join(shared, "transaction_id", "left_anti")


def net_customer_summary(tx: DataFrame) -> DataFrame:
    """Orders and amount of each customer over net orders."""
    return (
        net_orders(tx)
        .groupBy("customer_id")
        .agg(
            F.count("transaction_id").cast("double").alias("cnt_order"),
            F.sum("sum_amt").cast(MONEY_SUM).alias("sum_amt"),
        )
    )


def customer_lifetime(tx: DataFrame) -> DataFrame:
    """Order count, first and last purchase, and the days between them."""
    spans = (
        net_orders(tx)
        .groupBy("customer_id")
        .agg(
            F.count("transaction_id").alias("cnt_ord"),
            F.min("fst_dt").alias("fst_buy_dt"),
            F.max("lst_dt").alias("lst_buy_dt"),
        )
    )
    return spans.select(
        "customer_id",
        "cnt_ord",
        "fst_buy_dt",
        F.date_format("fst_buy_dt", "yyyy-MM").alias("fst_buy_ym"),
        "lst_buy_dt",
        F.date_format("lst_buy_dt", "yyyy-MM").alias("lst_buy_ym"),
        F.datediff("lst_buy_dt", "fst_buy_dt").alias("diff_days"),
    )


def repeat_purchase_cycle(lifetime: DataFrame, by: str | None = None) -> DataFrame:
    """Orders and mean purchase interval of customers with more than one order.

    ``by`` groups the result by one column of ``lifetime``, such as ``cnt_ord``. Everything is
    computed from the counts of (order count, span), which are far fewer than customers.
    """
    groups = [] if by is None else [f"by_{by}"]
    cells = (
        lifetime.where(F.col("cnt_ord") > 1)
        .select("cnt_ord", "diff_days", *(F.col(by).alias(g) for g in groups))
        .groupBy(*groups, "cnt_ord", "diff_days")
        .agg(F.count(F.lit(1)).alias("weight"))
        .withColumn("period", F.col("diff_days") / (F.col("cnt_ord") - 1))
    )
    found = medians(cells, groups, ["cnt_ord", "period"], 1, "weight")
    return found.select(
        *(F.col(g).alias(by) for g in groups),
        F.coalesce("n_cnt_ord", F.lit(0)).alias("n"),
        F.col("mean_cnt_ord").alias("per_ord"),
        F.col("med_cnt_ord").alias("med_ord"),
        F.col("mean_period").alias("avg_period"),
        F.col("med_period").alias("med_period"),
    )


def customer_period_summary(
    tx: DataFrame,
    window_months: int = 12,
    first_ym: str | None = None,
    last_ym: str | None = None,
) -> DataFrame:
    """Orders and amount per customer over the ``window_months`` months ending with each month.

    A month appears for a customer if at least one net line falls into its window. An order
    with lines in several months counts once per window. ``first_ym`` and ``last_ym`` bound
    the reference months.
    """
    day = F.col("tran_date")
    within = day.isNotNull()
    if first_ym is not None:
        start = F.add_months(F.lit(f"{first_ym}-01").cast("date"), 1 - window_months)
        within &= day >= start
    if last_ym is not None:
        within &= day < F.add_months(F.lit(f"{last_ym}-01").cast("date"), 1)
    dated = net_orders(tx.withColumn("ym", month_number(day)), "ym", within=within)
    # An order counts once however often it appears within a window: it begins to count where it has
    # not appeared for a window's length, and ends where it does not appear again within one.
    same_order = Window.partitionBy("transaction_id", "customer_id").orderBy("ym")
    wide = F.lit(window_months)
    named = F.col("transaction_id").isNotNull()
    begins = named & (F.coalesce(F.col("ym") - F.lag("ym").over(same_order), wide) >= wide)
    ends = named & (F.coalesce(F.lead("ym").over(same_order) - F.col("ym"), wide) >= wide)
    monthly = (
        dated.withColumns({"begins": begins.cast("long"), "ends": ends.cast("long")})
        .groupBy("customer_id", "ym")
        .agg(*(F.sum(c).alias(c) for c in ("begins", "ends", "sum_amt")))
    )
    # What a month adds when it enters the window, and takes away when it leaves. A customer has at
    # most two such rows per month, so their running sums are one small window.
    zero = F.lit(0).cast("long")
    changes = F.array(
        F.struct(F.col("ym").alias("at"), F.lit(1).alias("months"), F.col("begins").alias("cnt"), F.col("sum_amt").alias("amt")),
        F.struct((F.col("ym") + wide).alias("at"), F.lit(-1).alias("months"), (zero - F.col("ends")).alias("cnt"), (-F.col("sum_amt")).alias("amt")),
    )
    by_month = Window.partitionBy("customer_id").orderBy("at")
    upto = by_month.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = monthly.select("customer_id", F.inline(changes)).select(
        "customer_id",
        "at",
        (F.lead("at").over(by_month) - 1).alias("last"),
        *(F.sum(c).over(upto).alias(c) for c in ("months", "cnt", "amt")),
    )
    first, last = F.col("at"), F.col("last")
    if first_ym is not None:
        first = F.greatest(first, F.lit(month_number_of(first_ym)))
    if last_ym is not None:
        last = F.least(last, F.lit(month_number_of(last_ym)))
    held = running.where((F.col("months") > 0) & (first <= last))
    return held.select("customer_id", F.explode(F.sequence(first, last)).alias("std"), "cnt", "amt").select(
        "customer_id",
        month_text(F.col("std")).alias("std_ym"),
        F.col("cnt").alias("cnt_order"),
        F.col("amt").cast(MONEY_SUM).alias("sum_amt"),
    )
