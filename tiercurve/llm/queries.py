"""The registered queries of this subpackage, each over its whole table.

None has a DuckDB counterpart: their words, hashes, models, tokens or spans are beyond it. ``tests/llm`` holds
each against a brute-force version, an exact round trip or held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tiercurve.llm import (
    decontaminate,
    fingerprints,
    language,
    near_dedup,
    packing,
    periodic,
    quality,
    secrets,
    substring_dedup,
    token_output,
    toxicity,
    turns,
    warc,
)
from tiercurve.llm.common import table


def _over(query: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(*(table(spark, sf_dir, t) for t in tables))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": _over(toxicity.query, "documents", "labels"),
        "op2_substring_dedup": _over(substring_dedup.query, "documents"),
        "op3_fingerprints": _over(fingerprints.query, "documents"),
        "op4_quality": _over(quality.query, "documents", "labels"),
        "op5_decontamination": _over(decontaminate.query, "documents", "benchmark"),
        "op6_language": _over(language.query, "documents"),
        "op7_packing": _over(packing.query, "documents"),
        "op8_secrets": _over(secrets.query, "documents"),
        "op9_token_output": _over(token_output.query, "documents"),
        "op10_near_dedup": _over(near_dedup.query, "documents"),
        "op11_periodic_runs": _over(periodic.query, "documents"),
        "op12_warc": _over(warc.query, "pages"),
        "op13_turn_repair": _over(turns.query, "conversations"),
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {}
