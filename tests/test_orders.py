import random
from collections import defaultdict

import pytest
from conftest import by, day, money, plan_of

from tiercurve.operators import orders


def test_return_line_drops_whole_transaction(make_tx):
    tx = make_tx(
        (1, 7, "2019-01-01", 2, 10), (1, 7, "2019-01-01", -1, -5), (2, 7, "2019-01-02", 1, 3)
    )
    assert by(orders.net_customer_summary(tx), "customer_id") == {
        7: {"customer_id": 7, "cnt_order": 1.0, "sum_amt": money(3)}
    }


def test_return_of_another_customer_drops_the_transaction_too(make_tx):
    tx = make_tx((1, 7, "2019-01-01", 2, 10), (1, 8, "2019-01-01", -1, -5), (2, 8, "2019-01-02", 1, 3))
    assert set(by(orders.net_customer_summary(tx), "customer_id")) == {8}


def test_lines_without_transaction_id_are_kept(make_tx):
    tx = make_tx((None, 7, "2019-01-01", 1, 10), (None, 7, "2019-01-01", -1, -4))
    row = by(orders.net_customer_summary(tx), "customer_id")[7]
    assert (row["cnt_order"], row["sum_amt"]) == (0.0, money(6))


def test_lines_of_one_order_count_once(make_tx):
    tx = make_tx((1, 7, "2019-01-01", 1, 10), (1, 7, "2019-01-01", 1, 5))
    row = by(orders.net_customer_summary(tx), "customer_id")[7]
    assert (row["cnt_order"], row["sum_amt"]) == (1.0, money(15))


def test_null_quantity_is_no_return_and_null_customer_is_a_group(make_tx):
    tx = make_tx((1, None, "2019-01-01", None, 10), (2, None, "2019-01-01", 1, 5))
    row = by(orders.net_customer_summary(tx), "customer_id")[None]
    assert (row["cnt_order"], row["sum_amt"]) == (2.0, money(15))


def test_transaction_shared_by_many_customers(make_tx):
    rows = [(0, c, "2019-01-01", 1, c) for c in range(1, 200)]
    rows += [(5, c, "2019-01-01", -1 if c == 17 else 1, c) for c in range(1, 200)]
    got = by(orders.net_customer_summary(make_tx(*rows)), "customer_id")
    assert {c: r["sum_amt"] for c, r in got.items()} == {c: money(c) for c in range(1, 200)}


def test_lifetime(make_tx):
    tx = make_tx(
        (1, 7, "2019-02-01", 1, 1), (2, 7, "2019-02-10", 1, 1), (3, 7, "2019-03-01", 1, 1),
        (4, 7, "2019-09-01", -1, 1),
    )
    assert by(orders.customer_lifetime(tx), "customer_id")[7] == {
        "customer_id": 7, "cnt_ord": 3, "fst_buy_dt": day("2019-02-01"), "fst_buy_ym": "2019-02",
        "lst_buy_dt": day("2019-03-01"), "lst_buy_ym": "2019-03", "diff_days": 28,
    }


LIFETIME = "customer_id bigint, cnt_ord bigint, diff_days int"


def test_repeat_cycle(spark):
    lifetime = spark.createDataFrame([(1, 1, 0), (2, 3, 28), (3, 2, 30), (4, 3, 10), (5, 2, 7)], LIFETIME)
    row = orders.repeat_purchase_cycle(lifetime).collect()[0].asDict()
    assert row == {
        "n": 4, "per_ord": 2.5, "med_ord": 2.5, "avg_period": (14 + 30 + 5 + 7) / 4, "med_period": 10.5,
    }


def test_repeat_cycle_by_orders(spark):
    lifetime = spark.createDataFrame([(2, 3, 28), (3, 2, 30), (4, 3, 10), (5, 2, 7)], LIFETIME)
    got = by(orders.repeat_purchase_cycle(lifetime, "cnt_ord"), "cnt_ord")
    assert got[3] == {
        "cnt_ord": 3, "n": 2, "per_ord": 3.0, "med_ord": 3.0, "avg_period": 9.5, "med_period": 9.5,
    }
    assert (got[2]["n"], got[2]["med_period"]) == (2, 18.5)


def test_repeat_cycle_by_a_column_with_nulls(spark):
    rows = [(1, 2, 10, "2019-01"), (2, 2, 20, None), (3, 3, 20, None), (4, 2, None, None)]
    lifetime = spark.createDataFrame(rows, "customer_id bigint, cnt_ord bigint, diff_days int, fst_buy_ym string")
    got = by(orders.repeat_purchase_cycle(lifetime, "fst_buy_ym"), "fst_buy_ym")
    assert tuple(got[None].values()) == (None, 3, 7 / 3, 2.0, 15.0, 15.0)
    assert tuple(got["2019-01"].values()) == ("2019-01", 1, 2.0, 2.0, 10.0, 10.0)


def test_repeat_cycle_of_nobody(spark):
    row = orders.repeat_purchase_cycle(spark.createDataFrame([(1, 1, 0)], LIFETIME)).collect()
    assert [tuple(r) for r in row] == [(0, None, None, None, None)]


def test_period_summary_window(make_tx):
    tx = make_tx((1, 7, "2019-01-31", 1, 10), (2, 7, "2019-03-01", 1, 5))
    got = by(orders.customer_period_summary(tx, 3), "std_ym")
    assert {m: (r["cnt_order"], r["sum_amt"]) for m, r in got.items()} == {
        "2019-01": (1, money(10)), "2019-02": (1, money(10)), "2019-03": (2, money(15)),
        "2019-04": (1, money(5)), "2019-05": (1, money(5)),
    }


def test_period_summary_bounds(make_tx):
    tx = make_tx(
        (1, 7, "2018-12-31", 1, 10), (2, 7, "2019-03-01", 1, 5), (3, 7, "2019-06-01", 1, 1),
        (4, 7, "2019-05-31", 1, 2),
    )
    got = by(orders.customer_period_summary(tx, 2, "2019-01", "2019-05"), "std_ym")
    assert {m: (r["cnt_order"], r["sum_amt"]) for m, r in got.items()} == {
        "2019-01": (1, money(10)), "2019-03": (1, money(5)), "2019-04": (1, money(5)),
        "2019-05": (1, money(2)),
    }


@pytest.mark.parametrize("window", [1, 4])
def test_period_summary_against_brute_force(make_tx, window):
    rng = random.Random(window)
    rows = [
        (
            rng.choice([None, *range(40)]), rng.choice([None, 1, 2, 3]),
            f"2019-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
            -1 if rng.random() < 0.03 else 1, rng.randint(1, 99),
        )
        for _ in range(300)
    ]
    returned = {r[0] for r in rows if r[3] < 0} - {None}
    ids, amounts = defaultdict(set), defaultdict(int)
    for t, c, d, _, a in rows:
        if t not in returned:
            month = int(d[5:7]) - 1
            for m in range(month, month + window):
                key = (c, f"{2019 + m // 12}-{m % 12 + 1:02d}")
                amounts[key] += a
                ids[key] |= {t} - {None}
    got = by(orders.customer_period_summary(make_tx(*rows), window), "customer_id", "std_ym")
    assert {k: (r["cnt_order"], r["sum_amt"]) for k, r in got.items()} == {
        k: (len(ids[k]), money(a)) for k, a in amounts.items()
    }


def test_an_order_that_reappears_counts_once_per_window(make_tx):
    tx = make_tx((1, 7, "2019-01-05", 1, 10), (1, 7, "2019-02-05", 1, 1), (1, 7, "2019-08-05", 1, 5), (2, 7, "2019-02-01", 1, 2))
    got = by(orders.customer_period_summary(tx, 3), "std_ym")
    assert {m: (r["cnt_order"], r["sum_amt"]) for m, r in got.items()} == {
        "2019-01": (1, money(10)), "2019-02": (2, money(13)), "2019-03": (2, money(13)), "2019-04": (2, money(3)),
        "2019-08": (1, money(5)), "2019-09": (1, money(5)), "2019-10": (1, money(5)),
    }


def test_returns_are_looked_up_for_shared_transactions_only(make_tx, spark):
    own = make_tx((1, 7, "2019-01-01", 1, 1), (1, 7, "2019-01-01", -1, 1), (2, 8, "2019-01-01", 1, 1))
    plan = plan_of(orders.net_orders(own))
    assert "LeftAnti" in plan and "Generate" not in plan  # no copies of the returns
    assert by(orders.net_orders(own), "transaction_id").keys() == {2}


def test_a_return_outside_the_period_drops_the_transaction(make_tx):
    tx = make_tx((1, 7, "2019-01-15", 1, 10), (1, 7, "2020-06-15", -1, -10), (2, 7, "2019-01-20", 1, 3))
    got = by(orders.customer_period_summary(tx, 1, "2019-01", "2019-01"), "std_ym")
    assert (got["2019-01"]["cnt_order"], got["2019-01"]["sum_amt"]) == (1, money(3))
