from __future__ import annotations

import os
import sys
from datetime import date
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tiercurve import schemas  # noqa: E402
from tiercurve.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session
    session.stop()


def day(text: str | None) -> date | None:
    return None if text is None else date.fromisoformat(text)


def money(value) -> Decimal | None:
    return None if value is None else Decimal(str(value)).quantize(Decimal("0.01"))


@pytest.fixture(scope="session")
def make_tx(spark):
    """Transactions from (transaction, customer, date, qty, amount)."""

    def make(*rows):
        typed = [(t, c, day(d), q, money(a)) for t, c, d, q, a in rows]
        return spark.createDataFrame(typed, schemas.TRANSACTIONS)

    return make


@pytest.fixture(scope="session")
def make_his(spark):
    """Customer months from (customer, month, orders, amount); NULLs are let through."""
    schema = "customer_id bigint, std_ym string, cnt_order bigint, sum_amt decimal(28,2)"

    def make(*rows):
        return spark.createDataFrame([(c, m, n, money(a)) for c, m, n, a in rows], schema)

    return make


@pytest.fixture(scope="session")
def make_policy(spark):
    """Policy rows from (case, grade, name, orders, amount)."""

    def make(*rows):
        typed = [(g, c, n, o, money(a)) for g, c, n, o, a in rows]
        return spark.createDataFrame(typed, schemas.GRADE_POLICY)

    return make


@pytest.fixture(scope="session")
def make_labels(spark):
    """Labels from (customer, month, orders, amount, case, grade, name)."""
    schema = (
        "customer_id bigint, std_ym string, cnt_order bigint, sum_amt decimal(28,2), "
        "gb string, grd_cd int, grd_nm string, rn int"
    )

    def make(*rows):
        typed = [(c, m, n, money(a), g, k, name, 1) for c, m, n, a, g, k, name in rows]
        return spark.createDataFrame(typed, schema)

    return make


def by(df, *keys):
    """Rows as dictionaries by key."""
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
