"""Declared schemas of the input tables.

A sum of ``decimal(18,2)`` lines is ``decimal(28,2)`` in Spark; customer sums keep
that type, so that a customer with a very large share of all lines does not overflow.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
MONEY_SUM = T.DecimalType(28, 2)

TRANSACTIONS = T.StructType(
    [
        T.StructField("transaction_id", T.LongType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("tran_date", T.DateType()),
        T.StructField("qty", T.IntegerType()),
        T.StructField("total_amt", MONEY),
    ]
)

CUSTOMER_GRD_HIS = T.StructType(
    [
        T.StructField("customer_id", T.LongType()),
        T.StructField("std_ym", T.StringType(), nullable=False),
        T.StructField("cnt_order", T.LongType(), nullable=False),
        T.StructField("sum_amt", MONEY_SUM, nullable=False),
    ]
)

GRADE_POLICY = T.StructType(
    [
        T.StructField("gb", T.StringType(), nullable=False),
        T.StructField("grd_cd", T.IntegerType(), nullable=False),
        T.StructField("grd_nm", T.StringType()),
        T.StructField("std_ord", T.IntegerType(), nullable=False),
        T.StructField("std_amt", MONEY, nullable=False),
    ]
)

#: The star schema's orders as the analyses want them: no missing key, days, amounts in cents.
ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType(), nullable=False),
        T.StructField("o_custkey", T.LongType(), nullable=False),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", MONEY, nullable=False),
        T.StructField("o_orderdate", T.DateType(), nullable=False),
    ]
)

#: Lines of goods below 100,000 a line: what costs more does not fit.
LINES = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType(), nullable=False),
        T.StructField("l_quantity", T.ByteType(), nullable=False),
        T.StructField("l_extendedprice", T.DecimalType(7, 2), nullable=False),
    ]
)

TABLES = {
    "orders": ORDERS,
    "transactions": TRANSACTIONS,
    "customer_grd_his": CUSTOMER_GRD_HIS,
    "grade_policy": GRADE_POLICY,
}
