"""Every analysis as a query over the tables in one directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiercurve.operators import grades, orders, pareto, stats
from tiercurve.plans.whatif import WhatIf, grade_policy_whatif
from tiercurve.schemas import LINES, ORDERS
from tiercurve.sources.retail import RIVAL, customer_grd_his, grade_policy, transactions
from tiercurve.sources.tables import ParquetSource, load_table, violations

Query = Callable[[SparkSession, str], DataFrame]

CASES = {"case1": "case1", "case2": "case2", RIVAL: "rival"}
EXCLUDED_YM = "2000-01"
YEARS = (1997, 1998)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def _summary(spark, sf_dir):
    return orders.net_customer_summary(transactions(spark, sf_dir))


def _lifetime(spark, sf_dir):
    return orders.customer_lifetime(transactions(spark, sf_dir))


def _labels(spark, sf_dir, *cases):
    return grades.grade_label(customer_grd_his(spark, sf_dir), grade_policy(spark, *cases))


def _ranked(spark, sf_dir):
    """Labels of the case that customers are ranked and counted in."""
    return _labels(spark, sf_dir, "case1")


def _base(spark, sf_dir):
    return grades.graded_base(_ranked(spark, sf_dir))


def _whatif(spark, sf_dir) -> WhatIf:
    return grade_policy_whatif(
        customer_grd_his(spark, sf_dir),
        grade_policy(spark, "case1", RIVAL),
        grade_policy(spark, "case2"),
        CASES,
    )


def _repeat_cycle(spark, sf_dir, by=None):
    cycle = orders.repeat_purchase_cycle(_lifetime(spark, sf_dir), by)
    return _rounded(cycle, 6, "per_ord", "avg_period", "med_period")


def amount_box_stats(spark, sf_dir):
    box = stats.amount_box_stats(_summary(spark, sf_dir))
    return _rounded(box, 4, "q1", "med", "q3", "lo", "hi")


def monthly_box_stats(spark, sf_dir):
    box = stats.monthly_box_stats(customer_grd_his(spark, sf_dir), EXCLUDED_YM)
    return _rounded(box, 7, "q1", "med", "q3", "lo", "hi")


def grade_mix(spark, sf_dir):
    return grades.grade_mix_ratio(_labels(spark, sf_dir), CASES)


def vip_share_average(spark, sf_dir):
    share = grades.vip_share_by_month(_labels(spark, sf_dir))
    return _rounded(grades.vip_share_average(share), 9, "avg_prop")


def rank_band_stats(spark, sf_dir, lo, hi):
    band = grades.rank_band_stats(_ranked(spark, sf_dir), lo, hi)
    return _rounded(band, 6, "avg_cnt_ord", "avg_sum_amt", "med_sum_amt")


def target_headcount(spark, sf_dir, share):
    return _rounded(grades.target_headcount(_base(spark, sf_dir), share), 6, "avg")


def pareto_year(spark, sf_dir, yyyy):
    curve = pareto.pareto_curve(transactions(spark, sf_dir), [yyyy])
    return pareto.pareto_year(curve, yyyy)


def pareto_compare(spark, sf_dir, x_max=None, y_max=None):
    curve = pareto.pareto_curve(transactions(spark, sf_dir), YEARS)
    return pareto.pareto_compare(curve, YEARS, x_max, y_max)


def queries() -> dict[str, Query]:
    return {
        "net_customer_summary": _summary,
        "customer_lifetime": _lifetime,
        "repeat_purchase_cycle": _repeat_cycle,
        "repeat_purchase_cycle_by_orders": lambda s, d: _repeat_cycle(s, d, "cnt_ord"),
        "repeat_purchase_cycle_by_first_month": lambda s, d: _repeat_cycle(s, d, "fst_buy_ym"),
        "purchase_span_histogram": lambda s, d: stats.purchase_span_histogram(_lifetime(s, d)),
        "amount_box_stats": amount_box_stats,
        "median_amount_by_orders": lambda s, d: stats.median_amount_by_orders(_summary(s, d)),
        "monthly_box_stats": monthly_box_stats,
        "customer_period_summary": customer_grd_his,
        "grade_label": _labels,
        "graded_base": _base,
        "grade_mix_ratio": grade_mix,
        "grade_mix_percent": lambda s, d: grades.grade_mix_percent(_labels(s, d), CASES),
        "vip_share_by_month": lambda s, d: grades.vip_share_by_month(_labels(s, d)),
        "vip_share_average": vip_share_average,
        "target_headcount": lambda s, d: target_headcount(s, d, 0.01),
        "target_headcount_gold": lambda s, d: target_headcount(s, d, 0.2).select("avg"),
        "rank_band": lambda s, d: grades.rank_band(_ranked(s, d), 21, 25, newest_first=True),
        "rank_band_gold": lambda s, d: grades.rank_band(_ranked(s, d), 450, 490),
        "rank_band_stats": lambda s, d: rank_band_stats(s, d, 21, 25),
        "rank_band_stats_gold": lambda s, d: rank_band_stats(s, d, 460, 490),
        "pareto_curve": lambda s, d: pareto.pareto_curve(transactions(s, d)),
        "pareto_year": lambda s, d: pareto_year(s, d, YEARS[0]),
        "pareto_compare": pareto_compare,
        "pareto_compare_zoom": lambda s, d: pareto_compare(s, d, 0.3, 0.5),
        "grade_policy_whatif": lambda s, d: _whatif(s, d).mix,
        "grade_policy_whatif_percent": lambda s, d: _whatif(s, d).mix_percent,
        "grade_policy_whatif_vip": lambda s, d: _whatif(s, d).vip_share,
        "grade_policy_whatif_average": lambda s, d: _rounded(_whatif(s, d).vip_average, 9, "avg_prop"),
        "rank_band_wide": lambda s, d: grades.rank_band(_ranked(s, d), 100, 700),
        "rank_band_stats_wide": lambda s, d: rank_band_stats(s, d, 100, 700),
        "load_orders": lambda s, d: load_table(s, "orders", ParquetSource(d)),
        "order_violations": lambda s, d: violations(ParquetSource(d).read(s, "orders"), ORDERS),
        "lineitem_violations": lambda s, d: violations(ParquetSource(d).read(s, "lineitem"), LINES),
        "load_table": lambda s, d: load_table(s, "nation", ParquetSource(d)),
    }
