import pytest
from conftest import money, plan_of
from pyspark.sql import types as T

from tiercurve import schemas
from tiercurve.operators import orders, pareto
from tiercurve.sources import retail, tables

TINY = "/root/testdata/sf0.001"


def test_declared_schema_is_applied(spark, tmp_path):
    spark.sql("SELECT 1 AS qty, DATE'2019-01-01' AS tran_date, 2 AS customer_id, 3.5 AS total_amt, "
              "4 AS transaction_id, 'x' AS extra").write.parquet(str(tmp_path / "transactions.parquet"))
    df = tables.load_table(spark, "transactions", tables.ParquetSource(str(tmp_path)))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schemas.TRANSACTIONS]
    assert df.collect()[0].total_amt == money(3.5)


def test_null_in_required_column_fails(spark, make_his):
    make_his((1, "2020-01", None, 5)).createOrReplaceTempView("customer_grd_his")
    with pytest.raises(Exception, match="customer_grd_his.cnt_order must not be NULL"):
        tables.load_table(spark, "customer_grd_his").collect()
    spark.catalog.dropTempView("customer_grd_his")


def test_other_tables_are_read_whole(spark):
    df = tables.load_table(spark, "nation", tables.ParquetSource(TINY))
    assert df.columns == ["n_nationkey", "n_name", "n_regionkey"]
    assert df.count() == 25


def test_list_tables(spark):
    spark.range(1).createOrReplaceTempView("some_view")
    assert "some_view" in tables.list_tables(spark)
    spark.catalog.dropTempView("some_view")
    assert "some_view" not in tables.list_tables(spark)


def test_jdbc_options():
    source = tables.JdbcSource(
        "jdbc:postgresql://host/shop", {"user": "u", "password": "p"}, {"transactions": ("transaction_id", 0, 100, 8), "city": tables.ONE_TASK}
    )
    options = source.options("transactions")
    assert options["dbtable"] == "transactions" and options["user"] == "u"
    assert (options["partitionColumn"], options["numPartitions"]) == ("transaction_id", "8")
    assert "partitionColumn" not in source.options("city")
    assert "password" not in repr(source)
    with pytest.raises(ValueError, match="say in split how other is read"):
        source.options("other")


DECLARED = T.StructType([T.StructField("k", T.LongType(), False), T.StructField("d", T.DateType()), T.StructField("a", T.DecimalType(5, 2), False)])
RAW = [("1", "2020-01-02", "9.5"), (None, "2020-02-30", "1"), ("x", None, "1234.5"), ("4", "2020-01-02", None)]
BROKEN = {"k is no bigint": 1, "k is NULL": 1, "d is no date": 1, "a is no decimal(5,2)": 1, "a is NULL": 1}


def test_broken_rules_are_counted_in_the_pass_that_writes(spark, tmp_path):
    raw = spark.createDataFrame(RAW, "k string, d string, a string")
    table = tables.watched(raw, "things", DECLARED)
    table.df.write.parquet(str(tmp_path / "out"))
    assert table.counts() == BROKEN
    with pytest.raises(tables.ConstraintError, match="things: k is no bigint in 1 rows, k is NULL in 1 rows") as refused:
        table.check()
    assert refused.value.counts == BROKEN
    written = spark.read.parquet(str(tmp_path / "out"))
    assert dict(written.dtypes) == {"k": "bigint", "d": "date", "a": "decimal(5,2)"}
    assert sorted((r.k for r in written.collect()), key=str) == [1, 4, None, None]
    assert {r.rule: r.violations for r in tables.violations(raw, DECLARED).collect()} == BROKEN


def test_a_sound_table_passes(spark):
    table = tables.watched(spark.createDataFrame(RAW[:1], "k string, d string, a string"), "things", DECLARED)
    assert table.df.count() == 1
    table.check()
    assert set(table.counts().values()) == {0}


def test_a_missing_required_value_fails_the_load(spark, tmp_path):
    spark.createDataFrame([(1, None)], "o_orderkey long, o_custkey long").selectExpr(
        "*", "'O' AS o_orderstatus", "1.5D AS o_totalprice", "timestamp_ntz'2020-01-02 03:04:05' AS o_orderdate"
    ).write.parquet(str(tmp_path / "orders.parquet"))
    with pytest.raises(Exception, match="orders.o_custkey must not be NULL"):
        tables.load_table(spark, "orders", tables.ParquetSource(str(tmp_path))).collect()


def test_merged_lines_give_the_same_results(spark):
    lines, merged = retail.transaction_lines(spark, TINY), retail.transactions(spark, TINY)
    assert lines.count() == 6000
    assert merged.count() < lines.count()
    assert dict(lines.dtypes)["total_amt"] == "decimal(18,2)"
    for analysis in (orders.net_customer_summary, orders.customer_lifetime, pareto.pareto_curve):
        a, b = analysis(lines).collect(), analysis(merged).collect()
        assert len(a) > 0 and set(a) == set(b)


def test_policy_rows(spark):
    assert retail.grade_policy(spark).count() == 11
    assert {r.gb for r in retail.grade_policy(spark, "case2").collect()} == {"case2"}


def test_scan_reads_needed_columns_only(spark):
    plan = plan_of(orders.net_customer_summary(retail.transactions(spark, TINY)))
    assert "l_discount" not in plan and "l_shipdate" not in plan and "o_totalprice" not in plan
