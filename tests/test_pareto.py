import random
from decimal import Decimal

import pytest
from conftest import plan_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from tiercurve.operators import pareto
from tiercurve.operators.skew import hot_join
from tiercurve.schemas import MONEY_SUM


def curve(df):
    return {(r.yyyy, r.customer_id): (r.acc_cust_prop, r.acc_amt_prop) for r in df.collect()}


def year(make_tx, *amounts):
    return make_tx(*((i, i, "2017-05-01", 1, a) for i, a in enumerate(amounts, 1)))


def test_equal_customers_share_the_running_value(make_tx):
    got = curve(pareto.pareto_curve(year(make_tx, 10, 10, 5)))
    assert got == {(2017, 1): (2 / 3, 0.8), (2017, 2): (2 / 3, 0.8), (2017, 3): (1, 1)}


def test_negative_totals_rise_above_one(make_tx):
    got = curve(pareto.pareto_curve(year(make_tx, 10, 5, -5)))
    assert [v[1] for v in got.values()] == [1.0, 1.5, 1.0] or sorted(v[1] for v in got.values()) == [1.0, 1.0, 1.5]
    assert got[2017, 2] == (2 / 3, 1.5)


def test_returns_are_included(make_tx):
    tx = make_tx((1, 1, "2017-01-01", 1, 10), (1, 1, "2017-01-01", -1, -4), (2, 2, "2017-02-01", 1, 6))
    rows = {r.customer_id: r.amt_prop for r in pareto.pareto_curve(tx).collect()}
    assert rows == {1: 0.5, 2: 0.5}


def test_customer_without_amount_comes_first(make_tx):
    got = curve(pareto.pareto_curve(year(make_tx, 6, None, 0, 2)))
    assert got == {
        (2017, 2): (0.25, None), (2017, 1): (0.5, 0.75), (2017, 4): (0.75, 1.0), (2017, 3): (1.0, 1.0),
    }


def test_null_customer_and_null_date(make_tx):
    tx = make_tx(
        (1, None, "2017-01-01", 1, 5), (2, 1, "2017-01-01", 1, 5), (3, 2, "2017-01-01", 1, 1), (4, 3, None, 1, 9)
    )
    got = curve(pareto.pareto_curve(tx))
    assert got == {(2017, None): (1.0, 10 / 11), (2017, 1): (1.0, 10 / 11), (2017, 2): (1.5, 1.0)}


def plain_curve(tx):
    """The definition: one window per year."""
    yearly = (
        tx.where("tran_date IS NOT NULL").groupBy("customer_id", F.year("tran_date").alias("yyyy"))
        .agg(F.sum("total_amt").cast(MONEY_SUM).alias("s"))
    )
    whole = Window.partitionBy("yyyy")
    upto = whole.orderBy(F.col("s").desc_nulls_first())
    cust = F.count("customer_id").over(whole).cast("double")
    amt = F.sum("s").over(whole).cast("double")
    return yearly.select(
        "yyyy", "customer_id", (1 / cust).alias("cust_prop"),
        (F.count(F.lit(1)).over(upto) / cust).alias("acc_cust_prop"),
        (F.col("s").cast("double") / amt).alias("amt_prop"),
        (F.sum("s").over(upto).cast("double") / amt).alias("acc_amt_prop"),
    )


def test_curve_equals_one_window_per_year(make_tx):
    rng = random.Random(11)
    rows = []
    for i in range(900):
        # A third of the customers spend the same; the others are spread over many magnitudes.
        amount = 42 if rng.random() < 0.35 else round(rng.choice([-1, 1, 1, 1]) * 10 ** rng.uniform(0, 9), 2)
        rows.append((i, rng.choice([None, *range(600)]), f"{rng.randint(2017, 2019)}-03-01", 1, Decimal(str(amount))))
    tx = make_tx(*rows)
    key = lambda r: (r.yyyy, r.customer_id is None, r.customer_id or 0)
    assert sorted(pareto.pareto_curve(tx).collect(), key=key) == sorted(plain_curve(tx).collect(), key=key)


def test_years_reach_the_scan(make_tx, spark, tmp_path):
    path = str(tmp_path / "tx")
    make_tx((1, 1, "2017-05-01", 1, 3), (2, 1, "2018-05-01", 1, 4), (3, 2, "2019-05-01", 1, 4)).write.parquet(path)
    df = pareto.pareto_curve(spark.read.parquet(path), [2017, 2019])
    assert "GreaterThanOrEqual(tran_date,2017-01-01)" in plan_of(df)
    assert {r.yyyy for r in df.collect()} == {2017, 2019}


def test_year_and_compare(spark):
    points = spark.createDataFrame(
        [(2017, 1, 0.2, 0.4), (2017, 2, 0.5, 0.9), (2018, 1, 0.3, 0.5), (2019, 1, 0.1, 0.1)],
        "yyyy int, customer_id int, acc_cust_prop double, acc_amt_prop double",
    )
    assert [tuple(r) for r in pareto.pareto_year(points, 2018).collect()] == [(1, 0.3, 0.5)]
    zoom = pareto.pareto_compare(points, [2017, 2018], 0.3, 0.5).collect()
    assert [tuple(r) for r in zoom] == [(2017, 0.2, 0.4, 0.2), (2018, 0.3, 0.5, 0.3)]
    assert pareto.pareto_compare(points, [2017, 2018]).count() == 3


def test_year_without_revenue_fails_as_division_by_zero(make_tx):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        pareto.pareto_curve(year(make_tx, 5, -5)).collect()


def test_hot_join_against_a_plain_join(spark):
    big = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    small = big.where("k <> 11").groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    want = sorted(map(tuple, big.join(small, "k").select("k", "v", "n", "s").collect()))
    for hot in (1, 3, 1000):
        got = hot_join(big, small, ["k"], "n", ["v"], hot)
        assert got.columns == ["k", "v", "n", "s"] and sorted(map(tuple, got.collect())) == want
    heavy = hot_join(big, small, ["k"], "n", ["v"], 1)
    assert "BroadcastHashJoin" in plan_of(heavy) and "TakeOrderedAndProject(limit=1" in plan_of(heavy)


def test_a_step_window_has_one_row_per_point(make_tx):
    plan = plan_of(pareto.pareto_curve(year(make_tx, 10, 10, 5)))
    assert "_salt" not in plan
