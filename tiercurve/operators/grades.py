"""Grade labels, grade mix, VIP share and rank bands."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiercurve.functions.text import percent_text
from tiercurve.operators.quantiles import medians
from tiercurve.operators.running import ABOVE_ALL, BELOW_ALL, cell_offsets
from tiercurve.operators.stats import AMOUNT_STEP

GRADE_COLUMNS = ("grd_cd", "grd_nm", "std_ord", "std_amt")
MOST_POLICY_ROWS = 100_000
ID_BITS = 21
VIP = 10


def _thresholds(policy: DataFrame) -> Column:
    """All policy cases as one value: per case its grades with their thresholds, best grade first.

    A policy is a table of settings; one of more than ``MOST_POLICY_ROWS`` rows fails the job.
    """
    grade = F.struct(*GRADE_COLUMNS, F.col("std_amt").cast("double").alias("near"))
    cases = policy.groupBy("gb").agg(F.sort_array(F.collect_list(grade)).alias("grades"))
    size = F.sum(F.size("grades"))
    whole = F.collect_list(F.struct("gb", "grades"))
    refusal = F.raise_error(F.format_string(f"a policy has at most {MOST_POLICY_ROWS} rows, not %d", size))
    checked = F.when(size > MOST_POLICY_ROWS, refusal.cast("boolean")).otherwise(True)
    return cases.agg(F.when(checked, whole).alias("cases")).scalar()


def grade_label(his: DataFrame, policy: DataFrame) -> DataFrame:
    """Best grade (lowest ``grd_cd``) per customer, month and policy case.

    A customer has a grade if both thresholds are met; who meets none in a case is absent
    from it. The policy is read once, when the result is computed, and searched within each row, so
    labelling needs no join whatever the policy's size. Of repeated customer-months one row stays:
    that of the best grade, then most orders, then highest amount. Rows already placed by
    customer, as ``customer_period_summary`` leaves them, are not shuffled.
    """

    def met(grade: Column) -> Column:
        # Floats that differ decide as the decimals would; only equal ones need those.
        amount = F.when(F.col("_near") > grade["near"], True).when(F.col("_near") < grade["near"], False)
        return (F.col("cnt_order") >= grade["std_ord"]) & amount.otherwise(F.col("sum_amt") >= grade["std_amt"])

    def best(case: Column) -> Column:
        return F.struct(case["gb"].alias("gb"), F.get(F.filter(case["grades"], met), F.lit(0)).alias("best"))

    ruled = his.select("*", F.col("sum_amt").cast("double").alias("_near"), _thresholds(policy).alias("_policy"))
    found = ruled.select(*his.columns, F.explode(F.transform("_policy", best)).alias("_case"))
    matches = found.where(F.col("_case.best").isNotNull()).select(
        *his.columns, "_case.gb", *(f"_case.best.{c}" for c in GRADE_COLUMNS)
    )
    first = Window.partitionBy("customer_id", "std_ym", "gb").orderBy("grd_cd", F.desc("cnt_order"), F.desc("sum_amt"))
    return matches.withColumn("rn", F.row_number().over(first)).where(F.col("rn") == 1)


def graded_base(labels: DataFrame, gb: str = "case1") -> DataFrame:
    """Graded customers per month under one policy case."""
    return labels.where(F.col("gb") == gb).groupBy("std_ym").agg(F.count(F.lit(1)).alias("n"))


def _grade_counts(labels: DataFrame, base_gb: str, hidden: bool) -> DataFrame:
    """Customers per month, grade and case with the month's base ``n``, the graded customers of ``base_gb``.

    The base is taken from the counts themselves, so ``labels`` is read once. A ``hidden`` base case
    gives the base and no rows.
    """
    counts = labels.groupBy("std_ym", "grd_cd", "grd_nm", "gb").agg(F.count(F.lit(1)).alias("cnt"))
    graded = F.sum(F.when(F.col("gb") == base_gb, F.col("cnt"))).over(Window.partitionBy("std_ym"))
    based = counts.withColumn("n", graded).where(F.col("n").isNotNull())
    return based.where(F.col("gb") != base_gb) if hidden else based


def grade_mix_ratio(
    labels: DataFrame, cases: Mapping[str, str], base_gb: str = "case1", hidden_base: bool = False
) -> DataFrame:
    """Counts per month and grade with one column per case, and their shares of the base.

    ``cases`` maps each case to the prefix of its share column. A grade absent from a case
    has a NULL count and share there. With ``hidden_base`` the case ``base_gb`` is the base only.
    """
    counts = _grade_counts(labels, base_gb, hidden_base)
    wide = counts.groupBy("std_ym", "grd_cd", "grd_nm", "n").pivot("gb", list(cases)).agg(F.max("cnt"))
    return wide.select(
        "std_ym",
        "grd_cd",
        "grd_nm",
        *cases,
        "n",
        *((F.col(gb) / F.col("n")).alias(f"{prefix}_prop") for gb, prefix in cases.items()),
    )


def grade_mix_percent(
    labels: DataFrame, cases: Mapping[str, str], base_gb: str = "case1", hidden_base: bool = False
) -> DataFrame:
    """``grade_mix_ratio`` with the shares as text such as ``12.3%``."""
    mix = grade_mix_ratio(labels, cases, base_gb, hidden_base)
    texts = {f"{p}_prop": percent_text(F.col(f"{p}_prop")) for p in cases.values()}
    return mix.withColumns(texts)


def vip_share_by_month(
    labels: DataFrame, grd_cd: int = VIP, base_gb: str = "case1", hidden_base: bool = False
) -> DataFrame:
    """Share of one grade per month and case."""
    counts = _grade_counts(labels, base_gb, hidden_base)
    return counts.where(F.col("grd_cd") == grd_cd).withColumn("prop", F.col("cnt") / F.col("n"))


def vip_share_average(vip_share: DataFrame) -> DataFrame:
    """Mean monthly share per case."""
    return vip_share.groupBy("gb").agg(F.avg("prop").alias("avg_prop"))


def target_headcount(base: DataFrame, share: float) -> DataFrame:
    """Mean and median over months of the headcount that makes up ``share`` of the base."""
    target = F.bround(F.col("n") * F.lit(float(share)), 0)
    return base.select(target.alias("target_n")).agg(
        F.avg("target_n").alias("avg"), F.median("target_n").alias("med")
    )


def _band(labels: DataFrame, lo: int, hi: int, gb: str) -> DataFrame:
    """The rows of ``rank_band``, unsorted.

    A month is neither sorted nor shuffled as a whole. Customers are counted by the digits of their place, coarse to fine:
    grade, orders and step of the amount; the amount and the upper bits of the customer id; its middle bits.
    Running sums per digit tell the first and last leaf of each month that reach into the band. These bounds, one entry a
    month, are one value, so the labels are filtered where they are made. What is ranked at last are the
    rows of the band and of two leaves, in which ids differ in their last ``ID_BITS`` bits only, whatever the ties.
    """
    number = F.col("customer_id").cast("long")
    nobody = F.lit(1 << (64 - 2 * ID_BITS)).cast("long")  # after every customer
    amount = F.col("sum_amt")
    step = F.coalesce(F.floor(amount.cast("double") / F.lit(float(AMOUNT_STEP))), F.lit(BELOW_ALL).cast("long"))
    # Descending numbers are negated; two structs give the same order as their fields one by one.
    coarse = F.struct(
        F.coalesce(F.col("grd_cd").cast("long"), F.lit(ABOVE_ALL)).alias("grade"),
        (-F.coalesce(F.col("cnt_order").cast("long"), F.lit(BELOW_ALL))).alias("orders"),
        (-step).alias("step"),
    )
    fine = F.struct(
        F.coalesce(-amount, F.lit(0).cast(labels.schema["sum_amt"].dataType)).alias("amount"),
        F.coalesce(F.shiftright(number, 2 * ID_BITS), nobody).alias("high"),
    )
    mid = F.coalesce(F.shiftright(number, ID_BITS).bitwiseAND(F.lit((1 << ID_BITS) - 1)), F.lit(0).cast("long"))
    rows = labels.where(F.col("gb") == gb).select("*", coarse.alias("_coarse"), fine.alias("_fine"), mid.alias("_mid"))
    digits = ["_coarse", "_fine", "_mid"]
    leaves = rows.groupBy("std_ym", *digits).agg(F.count(F.lit(1)).alias("_n"))
    placed = cell_offsets(leaves, ["std_ym"], [{d: "asc"} for d in digits], ["_n"])
    in_band = placed.where((F.col("_n_before") + 1 < hi) & (F.col("_n_before") + F.col("_n") > lo))
    leaf = F.struct(*digits)
    months = in_band.groupBy("std_ym").agg(
        F.min(leaf).alias("first"), F.max(leaf).alias("last"), F.min("_n_before").alias("before")
    )
    bounds = F.map_from_entries(F.collect_list(F.struct("std_ym", F.struct("first", "last", "before"))))
    bounded = rows.select("*", months.agg(bounds).scalar().alias("_months"))
    near = bounded.select(*rows.columns, F.try_element_at("_months", F.col("std_ym")).alias("_month")).where(
        leaf.between(F.col("_month.first"), F.col("_month.last"))
    )
    in_month = Window.partitionBy("std_ym").orderBy(*digits, F.col("customer_id").asc_nulls_last())
    rank = (F.col("_month.before") + F.row_number().over(in_month)).cast("int")
    # Replaces the ``rn`` of the labels, which is 1 throughout.
    ranked = near.withColumn("rn", rank).where((F.col("rn") > lo) & (F.col("rn") < hi))
    return ranked.select(*labels.columns, *(["rn"] if "rn" not in labels.columns else []))


def rank_band(
    labels: DataFrame, lo: int, hi: int, gb: str = "case1", newest_first: bool = False
) -> DataFrame:
    """Customers whose rank in their month lies strictly between ``lo`` and ``hi``.

    Ranked by grade, then most orders, then highest amount, then customer id; NULLs last.
    """
    month = F.col("std_ym").desc_nulls_last() if newest_first else F.col("std_ym").asc_nulls_last()
    return _band(labels, lo, hi, gb).orderBy(month, "rn")


def rank_band_stats(labels: DataFrame, lo: int, hi: int, gb: str = "case1") -> DataFrame:
    """Mean and median of orders and amount over a rank band."""
    band = _band(labels, lo, hi, gb).select("cnt_order", "sum_amt")
    found = medians(band, [], ["cnt_order", "sum_amt"], AMOUNT_STEP)
    return found.select(
        F.col("mean_cnt_order").alias("avg_cnt_ord"),
        F.col("mean_sum_amt").alias("avg_sum_amt"),
        F.col("med_cnt_order").alias("med_cnt_ord"),
        "med_sum_amt",
    )
