import re

import numpy as np
import pytest
from conftest import by, money, plan_of

from tiercurve.functions.text import percent_text
from tiercurve.operators import quantiles, stats
from pyspark.sql import functions as F


def test_histogram_edges(spark):
    spans = [0, 25, 26, 75, 76, 1200, None]
    life = spark.createDataFrame([(i, 2, d) for i, d in enumerate(spans)], "customer_id int, cnt_ord bigint, diff_days int")
    got = {r.bin_center: r.n for r in stats.purchase_span_histogram(life).collect()}
    assert got == {0: 2, 50: 2, 100: 1, 1200: 1}


SUMMARY = "cnt_order double, sum_amt decimal(28,2)"


def summary(spark, groups):
    return spark.createDataFrame([(float(k), money(v)) for k, vs in groups.items() for v in vs], SUMMARY)


def test_box_stats(spark):
    got = by(stats.amount_box_stats(summary(spark, {1: [1, 2, 3, 4, 100], 2: [7]})), "cnt_order")
    assert got[1.0] == {"cnt_order": 1.0, "n": 5, "q1": 2, "med": 3, "q3": 4, "lo": 1, "hi": 4, "n_out": 1}
    assert got[2.0] == {"cnt_order": 2.0, "n": 1, "q1": 7, "med": 7, "q3": 7, "lo": 7, "hi": 7, "n_out": 0}


def test_whisker_ends_at_the_box_if_no_value_lies_between(spark):
    got = by(stats.amount_box_stats(summary(spark, {1: [-100, 10, 10, 10]})), "cnt_order")[1.0]
    assert (got["q1"], got["lo"], got["n_out"]) == (-17.5, -17.5, 1)


def test_box_stats_ignore_null_amounts(spark):
    got = by(stats.amount_box_stats(summary(spark, {1: [1, None, 3], 2: [None]})), "cnt_order")
    assert set(got) == {1.0}
    assert (got[1.0]["n"], got[1.0]["med"], got[1.0]["n_out"]) == (2, 2, 0)


def test_box_stats_of_a_null_key(spark):
    rows = [(None, "x", 1.0), (None, "x", 3.0), ("a", "x", 5.0), (None, None, 7.0)]
    got = stats.box_stats(spark.createDataFrame(rows, "k string, l string, v double"), ["k", "l"], "v").collect()
    assert {(r.k, r.l): (r.n, r.med, r.lo, r.hi) for r in got} == {(None, "x"): (2, 2, 1, 3), ("a", "x"): (1, 5, 5, 5), (None, None): (1, 7, 7, 7)}


def test_quantiles_of_a_null_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 4.0), (2, 9.0), (2, None)], "k int, v double")
    got = quantiles.quantiles(df, ["k"], "v", {"med": 0.5}, 1).drop("mean")
    assert sorted(map(tuple, got.collect()), key=str) == [(2, 1, 9.0), (None, 2, 2.5)]


def test_median_and_label(spark):
    got = by(stats.median_amount_by_orders(summary(spark, {1: [2500], 2: [1234500], 3: [1, 2, 3, 10], 4: [3500]})), "cnt_order")
    assert [got[k]["label"] for k in (1.0, 2.0, 4.0)] == ["2천원", "1,234천원", "4천원"]
    assert got[3.0]["med"] == 2.5


def test_monthly_box_scales_and_excludes(make_his):
    his = make_his((1, "2020-01", 1, 1000), (1, "2020-02", 1, 1000), (2, "2020-02", 1, 3000))
    got = by(stats.monthly_box_stats(his), "std_ym")
    assert set(got) == {"2020-02"}
    assert (got["2020-02"]["med"], got["2020-02"]["lo"], got["2020-02"]["hi"]) == (2.0, 1.0, 3.0)


def test_percent_text(spark):
    df = spark.createDataFrame([(0.1225,), (0.1235,), (0.0105,), (None,)], "x double")
    assert [r[0] for r in df.select(percent_text(F.col("x"))).collect()] == ["12.2%", "12.4%", "1.0%", None]


@pytest.mark.parametrize("width", [0.5, 40, 10**6])
def test_box_stats_against_numpy(spark, width):
    rng = np.random.default_rng(4)
    groups = {
        "wide": np.r_[rng.normal(0, 300, 400), rng.normal(0, 3000, 40)].round(2),
        "hot": np.r_[np.full(300, 77.5), rng.exponential(50, 150).round(2), [1e6, -1e6]],
        "far": np.array([1.0, 2, 3, 4, 1000, 2000, -5000]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    got = by(stats.box_stats(df, ["k"], "v", width), "k")
    for k, vs in groups.items():
        q1, med, q3 = np.quantile(vs, [0.25, 0.5, 0.75])
        inside = vs[(vs >= q1 - 1.5 * (q3 - q1)) & (vs <= q3 + 1.5 * (q3 - q1))]
        want = [len(vs), q1, med, q3, min(inside.min(), q1), max(inside.max(), q3), len(vs) - len(inside)]
        assert np.allclose([got[k][c] for c in ("n", "q1", "med", "q3", "lo", "hi", "n_out")], want, rtol=0, atol=1e-9)


def test_box_stats_take_few_exchanges(spark, make_his):
    his = make_his((1, "2020-02", 1, 1000))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(stats.monthly_box_stats(his.repartition("customer_id")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Copies of the same exchange are run once.
    exchanges = {re.sub(r"#\d+L?", "", line.split("Exchange ")[1].split(", [plan_id")[0]) for line in plan.splitlines() if "Exchange " in line}
    assert len(exchanges) <= 10, exchanges


def test_medians_of_columns_side_by_side(spark):
    df = spark.createDataFrame([("a", 1, 10.0, 2), ("a", 5, None, 1), ("b", 7, 3.0, 1)], "k string, x int, y double, w int")
    got = by(quantiles.medians(df, ["k"], ["x", "y"], 10, "w"), "k")
    assert got["a"] == {"k": "a", "n_x": 3, "mean_x": 7 / 3, "med_x": 1.0, "n_y": 2, "mean_y": 10.0, "med_y": 10.0}
    assert got["b"]["med_y"] == 3.0
    assert [tuple(r) for r in quantiles.medians(df.where("false"), [], ["x"], 10).collect()] == [(None, None, None)]


@pytest.mark.parametrize("width", [0.5, 50, 10**6])
def test_quantiles_against_numpy(spark, width):
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.normal(0, 300, 500).round(2),
        "hot": np.r_[np.full(400, 77.5), rng.exponential(50, 200).round(2)],
        "single": np.array([-3.25]),
        "pair": np.array([1.0, 2.0]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    probs = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = by(quantiles.quantiles(df, ["k"], "v", probs, width), "k")
    for k, vs in groups.items():
        want = np.quantile(vs, list(probs.values()))
        assert np.allclose([got[k][p] for p in probs], want, rtol=0, atol=1e-9)
        assert got[k]["n"] == len(vs)


def test_weighted_quantiles_without_keys(spark):
    df = spark.createDataFrame([(1, 3), (5, 1), (None, 9)], "v int, w int")
    assert quantiles.quantiles(df, [], "v", {"med": 0.5}, 10, "w").collect()[0].med == 1.0
    assert quantiles.quantiles(df.where("v > 9"), [], "v", {"med": 0.5}, 10, "w").collect() == []
