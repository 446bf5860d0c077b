"""From raw documents to packed sequences of token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the one before has kept, and is written as Parquet
before the next reads it. All but the last return the columns of ``docs``. ``docs`` may have nulls anywhere (a null
text is scored as empty, is in no class, holds no window, and leaves the fourth stage empty), repeated rows, further
columns of any name, and no rows at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiercurve.llm import decontaminate, near_dedup, packing, secrets, toxicity
from tiercurve.llm.common import folded, table, unfolded, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The model learns from the labels of all documents in ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", F.lit(True))
    return unfolded(toxicity.score(folded(docs), model).where(F.col("score") < 0.5), docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays; documents without words are in no class."""
    return unfolded(near_dedup.one_of_each(folded(docs)), docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    marked = decontaminate.contamination(folded(docs), table(spark, sf_dir, "benchmark"))
    return unfolded(marked.where(F.col("hit_bits").isNull()), docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets replaced; ``n_chars``, if there is one, is that of the new text."""
    found = secrets.redacted(secrets.secrets(folded(docs)))
    out = unfolded(found, docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its document, its sequence and place there, and its token ids.

    The workers serve other stages too, so they remember few words.
    """
    return packing.pack(docs, remembered=REMEMBERED)


REMEMBERED = 50_000

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", pack),
]

#: Models, signatures and tokens are beyond SQL; tests/llm holds the stages against plain versions or planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
