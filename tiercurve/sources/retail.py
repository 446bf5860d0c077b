"""The retail tables, made from the star-schema tables that are at hand.

``transactions`` comes from ``lineitem`` and ``orders``; a line flagged ``R`` with status ``F``
is a return, which gets a negative quantity and amount. ``grade_policy`` is a literal.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiercurve.operators.orders import customer_period_summary
from tiercurve.schemas import GRADE_POLICY, MONEY, MONEY_SUM
from tiercurve.sources.tables import conform

RIVAL = "경쟁사"

# Minimum orders and minimum amount per policy case and grade.
POLICY_ROWS = """
    ('case1', 10, 'VIP', 4, 700000),
    ('case1', 20, 'GOLD', 2, 350000),
    ('case1', 30, 'SILVER', 1, 200000),
    ('case1', 40, 'FAMILY', 0, 0),
    ('case2', 10, 'VIP', 3, 750000),
    ('case2', 20, 'GOLD', 2, 400000),
    ('case2', 30, 'SILVER', 1, 200000),
    ('case2', 40, 'FAMILY', 0, 0),
    ('경쟁사', 10, 'VIP', 3, 600000),
    ('경쟁사', 20, 'GOLD', 2, 300000),
    ('경쟁사', 30, 'SILVER', 1, 100000)
"""


LINEITEM = "l_orderkey bigint, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz"


def _signed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order key, signed quantity and signed cents of each line."""
    is_return = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    sign = F.when(is_return, -1).otherwise(1)
    return spark.read.schema(LINEITEM).parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey",
        (F.col("l_quantity") * sign).cast("int").alias("qty"),
        (F.rint(F.col("l_extendedprice") * 100).cast("bigint") * sign).alias("cents"),
    )


def _of_orders(lines: DataFrame, sf_dir: str, *columns: Column) -> DataFrame:
    """The columns of ``lines`` with the transaction, customer and date of their order."""
    orders = lines.sparkSession.read.schema(ORDERS).parquet(f"{sf_dir}/orders.parquet")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("tran_date"),
        *columns,
    )


def _money(cents: Column, of: T.DecimalType) -> Column:
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(of)


def transaction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line."""
    amount = _money(F.col("cents"), MONEY).alias("total_amt")
    return _of_orders(_signed_lines(spark, sf_dir), sf_dir, F.col("qty"), amount)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines, those of one order and kind (sold or returned) merged before the join.

    The analyses read ids, dates, signs and sums only, so they give the same results. The lines
    are summed where they are read, so an order with a huge number of lines cannot make the
    join lopsided, and about a quarter of the rows are shuffled.
    """
    is_return = F.coalesce(F.col("qty") < 0, F.lit(False))

    def merged(kind: Column, name: str) -> Column:
        parts = {
            "lines": F.count(F.when(kind, F.lit(1))),
            "qty": F.sum(F.when(kind, F.col("qty"))),
            "total_amt": _money(F.sum(F.when(kind, F.col("cents"))), MONEY_SUM),
        }
        return F.struct(*(c.alias(k) for k, c in parts.items())).alias(name)

    merged_lines = (
        _signed_lines(spark, sf_dir)
        .groupBy("l_orderkey")
        .agg(merged(is_return, "back"), merged(~is_return, "sold"))
    )
    both = _of_orders(merged_lines, sf_dir, F.inline(F.array("back", "sold")))
    return both.where(F.col("lines") > 0).drop("lines")


def customer_grd_his(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer totals for every month whose 12 months hold a net line, whatever years the data cover."""
    return customer_period_summary(transactions(spark, sf_dir), 12)


def grade_policy(spark: SparkSession, *cases: str) -> DataFrame:
    """The policy rows, of the named cases if any are named."""
    rows = spark.sql(f"SELECT * FROM VALUES {POLICY_ROWS} AS t(gb, grd_cd, grd_nm, std_ord, std_amt)")
    policy = conform(rows, "grade_policy", GRADE_POLICY)
    return policy.where(F.col("gb").isin(list(cases))) if cases else policy
