"""What several operators share: scratch tables, bounded samples, and words of Arrow text as numpy arrays.

Texts are worked on as bytes. ``Words`` finds the words of many documents at once, never across two
documents, and hashes them and their n-grams with prefix sums of polynomials modulo 2**64, so no
Python code runs for a single word.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 4096
_WORD_BASE, _GRAM_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Where it is unset, a session in one process gets a local folder; any other fails, since a folder of the driver's would
    hold no rows that executors wrote.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_scratch()


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="llm-")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = f"{scratch(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folded(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, rest)``: other columns in one struct, so that their names cannot clash with an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("doc_id"), *others).alias("rest"))


def unfolded(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names`` again, as they were before ``folded``."""
    return df.select(*(F.col(n) if n in ("doc_id", "text") else F.col("rest").getField(n).alias(n) for n in names))


def fields(kept: list[StructField], ddl: str) -> StructType:
    """A schema of some known fields and those of ``ddl``."""
    return StructType([*kept, *StructType.fromDDL(ddl).fields])


def with_column(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of ``df`` with one more column."""
    return fields(df.schema.fields, f"{name} {kind}")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def bounded_sample(df: DataFrame, group: str, key: Column, per_group: int, repeated: bool = False) -> tuple[DataFrame, dict]:
    """About ``per_group`` rows of each value of ``group`` (all, if it has fewer), chosen by the hash of ``key``.

    Returns the sample and the row count of each value. Equal keys are taken together; if they may be
    ``repeated``, ``per_group`` bounds the distinct keys of a value, each with all its rows. Values are
    expected to be few (classes, languages): their counts go to the driver, rows do not.
    """
    wanted = [F.count(F.lit(1)), *([F.count_distinct(F.xxhash64(key))] if repeated else [])]
    found = df.where(F.col(group).isNotNull()).groupBy(group).agg(*wanted).collect()
    share = F.lit(0.0)
    for row in found:
        share = F.when(F.col(group) == F.lit(row[0]), F.lit(min(1.0, per_group / row[-1]))).otherwise(share)
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    return df.where(F.col(group).isNotNull() & (draw < share)), {r[0]: r[1] for r in found}


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int
) -> tuple[DataFrame, dict]:
    """``(doc_id, text, label)`` of a bounded sample of the labelled documents that ``learn`` admits.

    A document labelled more than once counts with its highest label. The sampled labels are at most
    about ``2 * per_class`` rows whatever the input, so that the join may send them to all executors.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).alias("label")).where(learn)
    )
    chosen, counts = bounded_sample(known, "label", F.col("doc_id"), per_class)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), counts


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at the end the worker, which serves other tasks later, gives freed memory back."""
    yield from batches
    release()


def release() -> None:
    """Gives memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def text_chunks(
    batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of rows with about ``limit`` bytes of text; null is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), first + CHUNK_ROWS, len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set for bytes in the inclusive ranges."""
    flags = np.zeros(256, bool)
    for low, high in ranges:
        flags[low : high + 1] = True
    return flags


#: Words between ASCII white space: [^\x20\x09-\x0D]+
SPACED = ~byte_set((0x20, 0x20), (0x09, 0x0D))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``base`` and of its inverse, modulo 2**64."""
    for b in (base, pow(base, -1, 1 << 64)):
        if b not in _powers or len(_powers[b]) < n:
            size = max(n, CHUNK_BYTES + 2)
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            kept = np.cumprod(steps, dtype=np.uint64)
            if size > 8 * CHUNK_BYTES:
                if b == base:
                    inverse = np.full(size, pow(base, -1, 1 << 64), np.uint64)
                    inverse[0] = 1
                    return kept[:n], np.cumprod(inverse, dtype=np.uint64)[:n]
            _powers[b] = kept
    return _powers[base][:n], _powers[pow(base, -1, 1 << 64)][:n]


class Prefix:
    """Hashes of any stretch of a sequence of numbers in constant time."""

    def __init__(self, values: np.ndarray, base: int):
        power, self.inverse = _power(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self.sums[1:], dtype=np.uint64)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


class Words:
    """The words of some documents: byte positions ``start`` and ``end``, and ``first[d]`` to ``first[d + 1]`` of document d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = in_word[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.first = np.searchsorted(self.start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def hashes(self, base: int = _WORD_BASE) -> np.ndarray:
        return Prefix(self.data.astype(np.uint64) + np.uint64(1), base)(self.start, self.end)

    def gram_starts(self, n: int) -> np.ndarray:
        """Positions of the words at which ``n`` words of one document begin."""
        left = np.repeat(self.first[1:], self.counts()) - np.arange(len(self.start))
        return np.flatnonzero(left >= n)

    def text(self, start: int, end: int) -> bytes:
        """The words from ``start`` to before ``end``, joined by one space."""
        data = self.data
        return b" ".join([data[s:e].tobytes() for s, e in zip(self.start[start:end], self.end[start:end], strict=True)])


def grams(word_hashes: np.ndarray, base: int = _GRAM_BASE) -> Prefix:
    return Prefix(word_hashes, base)
