"""Named tables read whole, from parquet or over JDBC, under their declared schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiercurve.schemas import TABLES


ONE_TASK = None


@dataclass(frozen=True)
class ParquetSource:
    """Tables stored as ``<root>/<name><suffix>``."""

    root: str
    suffix: str = ".parquet"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.root.rstrip('/')}/{name}{self.suffix}")


@dataclass(frozen=True)
class JdbcSource:
    """Tables of a database. URL, user and password come from the caller.

    ``split`` says for each table how it is read: by the column to split on, its bounds and the
    number of tasks, ``{"transactions": ("transaction_id", 0, 10**9, 400)}``, or by ``ONE_TASK``. The
    bounds only set the stride; rows outside them are read too. A table that is not in it is refused.
    """

    url: str
    properties: dict[str, str] = field(default_factory=dict, repr=False)
    split: dict[str, tuple[str, object, object, int] | None] = field(default_factory=dict)
    fetch_size: int = 10_000

    def options(self, name: str) -> dict[str, str]:
        chosen = {"url": self.url, "dbtable": name, "fetchsize": str(self.fetch_size)}
        if name not in self.split:
            raise ValueError(f"say in split how {name} is read, by a column's ranges or by ONE_TASK")
        if self.split[name] is not ONE_TASK:
            column, lower, upper, tasks = self.split[name]
            chosen |= {
                "partitionColumn": column,
                "lowerBound": str(lower),
                "upperBound": str(upper),
                "numPartitions": str(tasks),
            }
        return {**self.properties, **chosen}

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.format("jdbc").options(**self.options(name)).load()


def _rules(schema: T.StructType) -> dict[str, Column]:
    """What a row of the table as it is must not be, by the name of the rule."""
    rules = {}
    for f in schema.fields:
        given = F.col(f.name)
        fits = given.try_cast(f.dataType).isNotNull()
        rules[f"{f.name} is no {f.dataType.simpleString()}"] = given.isNotNull() & ~fits
        if not f.nullable:
            rules[f"{f.name} is NULL"] = given.isNull()
    return rules


def violations(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``(rule, violations)``: how many rows break each rule of a declared schema, in one pass."""
    rules = _rules(schema)
    counts = df.select(*(F.count_if(broken).alias(f"r{i}") for i, broken in enumerate(rules.values())))
    pairs = (F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("violations")) for i, rule in enumerate(rules))
    return counts.select(F.inline(F.array(*pairs)))


def _declared(name: str, field: T.StructField) -> Column:
    column = F.col(field.name).cast(field.dataType)
    if not field.nullable:
        message = F.lit(f"{name}.{field.name} must not be NULL")
        column = F.coalesce(column, F.raise_error(message).cast(field.dataType))
    return column.alias(field.name)


def conform(df: DataFrame, name: str, schema: T.StructType) -> DataFrame:
    """The declared columns with their declared types; a NULL in a required column fails the job."""
    return df.select(*(_declared(name, f) for f in schema.fields))


class ConstraintError(ValueError):
    """A table breaks its declared schema; ``counts`` has the rows that break each rule."""

    def __init__(self, name: str, counts: dict[str, int]):
        super().__init__(f"{name}: " + ", ".join(f"{rule} in {n} rows" for rule, n in counts.items()))
        self.counts = counts


@dataclass(frozen=True)
class Watched:
    """A table under its declared schema whose rules are counted while it is read, in the same pass.

    ``df`` holds NULL where a value does not fit. After an action on all of it, ``check`` tells what
    was broken, rule by rule; a job that writes ``df`` calls it before the result is published.
    """

    name: str
    df: DataFrame
    seen: Observation
    rules: tuple[str, ...]

    def counts(self) -> dict[str, int]:
        """Rows that broke each rule; waits for an action on ``df``."""
        found = self.seen.get
        return {rule: found[f"r{i}"] for i, rule in enumerate(self.rules)}

    def check(self) -> None:
        broken = {rule: n for rule, n in self.counts().items() if n}
        if broken:
            raise ConstraintError(self.name, broken)


def watched(df: DataFrame, name: str, schema: T.StructType) -> Watched:
    rules = _rules(schema)
    seen = Observation(f"constraints of {name}")
    counted = df.observe(seen, *(F.count_if(broken).alias(f"r{i}") for i, broken in enumerate(rules.values())))
    typed = counted.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields))
    return Watched(name, typed, seen, tuple(rules))


def load_table(
    spark: SparkSession,
    name: str,
    source: ParquetSource | JdbcSource | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Read a table whole; without a source it is taken from the session catalog.

    Tables of ``schemas.TABLES`` get their declared schema unless another one is given;
    other tables keep the schema they have.
    """
    df = spark.table(name) if source is None else source.read(spark, name)
    schema = schema or TABLES.get(name)
    return df if schema is None else conform(df, name, schema)


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of the tables and views known to the session."""
    return sorted(t.name for t in spark.catalog.listTables(database))
