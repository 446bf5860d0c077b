"""Joins that do not send one hot key to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1000
_SPREAD = "_spread"


def hot_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    weight: str,
    spread: Sequence[str],
    hot: int = HOT,
) -> DataFrame:
    """Inner join of ``big`` with one row per key of ``small``, whose ``weight`` is the key's rows in ``big``.

    The ``hot`` heaviest keys, at most so many rows, are looked up by broadcast. Their rows go to the
    shuffle under keys of their own, made from the columns ``spread``, and meet nothing there; the
    other keys meet their row. So no task gets more than one part in ``hot`` of all rows by one key.
    ``on`` is non-null. The result has the columns of ``big`` and the other ones of ``small``.
    """
    rest = [c for c in small.columns if c not in on]
    values = F.struct(*rest)
    heaviest = small.orderBy(F.col(weight).desc(), *on).limit(hot).select(*on, values.alias("_hot"))
    apart = F.when(F.col("_hot").isNotNull(), F.coalesce(F.xxhash64(*spread), F.lit(0).cast("long")).bitwiseOR(F.lit(1)))
    looked_up = big.join(F.broadcast(heaviest), list(on), "left").withColumn(_SPREAD, F.coalesce(apart, F.lit(0).cast("long")))
    others = small.select(*on, F.lit(0).cast("long").alias(_SPREAD), values.alias("_cold"))
    met = looked_up.join(others, [*on, _SPREAD], "left").withColumn("_hot", F.coalesce("_hot", "_cold"))
    return met.where(F.col("_hot").isNotNull()).select(*big.columns, "_hot.*")
