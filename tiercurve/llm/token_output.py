"""Token ids on disk, each in as few bits as the vocabulary needs.

The files are Parquet tables of blocks, written by Spark so that a lost executor leaves no half file. A
block holds whole documents, about ``BLOCK`` ids or one longer document:

* ``part``, ``block``: blocks of one part follow each other, and parts do, in ascending ``doc_id``;
* ``first``: ids before the block within its part; ``n_ids``: ids in it; ``bits``: width of an id;
* ``payload``: the ids, least significant bit first, without gaps;
* ``doc_ids``, ``lengths``: its documents in order and their ids, the end id included.

The part offsets are sums over the table, so an id's place leads to its part, block and bits: ``read_range`` reads the
payloads of the blocks it needs alone. Null and empty texts are the end id alone. Null ``doc_id`` comes first; rows of one id
are ordered by a digest of their text, by which they are dealt to several tasks. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiercurve.llm.common import fields, scratch
from tiercurve.llm.tokens import default_path, encoder, groups, vocabulary, with_end

BLOCK = 1 << 16


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` (below 2**bits, at most 32 bits) in ``bits`` bits each."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return raw[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(payload: bytes, n: int, bits: int, start: int = 0) -> np.ndarray:
    """``n`` ids from id ``start`` on."""
    if bits % 8 == 0:
        width = bits // 8
        out = np.zeros((n, 4), np.uint8)
        out[:, :width] = np.frombuffer(payload, np.uint8, n * width, start * width).reshape(n, width)
        return out.view("<u4").ravel()
    first = start * bits
    held = np.frombuffer(payload, np.uint8)[first // 8 : (first + n * bits + 7) // 8]
    flags = np.unpackbits(held, bitorder="little")[first % 8 : first % 8 + n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flags
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Writes the ids of all texts to ``path``, each document followed by ``end_id``."""
    bits = max(vocabulary(tokenizer) - 1, end_id, 1).bit_length()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first = TaskContext.get().partitionId(), 0, 0
        encode = encoder(tokenizer)
        for batch in batches:
            keys = batch.column("doc_id")
            for row, texts in groups(batch.column("text")):
                ids, cuts = with_end(*encode(texts), end_id)
                start = 0
                while start < len(texts):
                    end = max(start + 1, int(np.searchsorted(cuts, cuts[start] + BLOCK, "right")) - 1)
                    n = int(cuts[end] - cuts[start])
                    names = pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), keys.slice(row + start, end - start))
                    lengths = pa.array([np.diff(cuts[start : end + 1])], pa.list_(pa.int64()))
                    values = [part, block, first, n, bits, pack(ids[cuts[start] : cuts[end]], bits)]
                    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                    columns = [pa.array([v], kind) for v, kind in zip(values, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, names, lengths], schema.names)
                    block, first, start = block + 1, first + n, end

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = fields([], f"part int, block int, first long, n_ids long, bits int, payload binary, doc_ids array<{key}>, lengths array<bigint>")
    place = ["doc_id", F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(*place).sortWithinPartitions(*place, "text")
    ordered.mapInArrow(blocks, schema).write.parquet(path)


def _offsets(blocks: DataFrame) -> DataFrame:
    """``(part, base)``: the ids before each part."""
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_range(spark: SparkSession, path: str, start: int, n: int) -> np.ndarray:
    """The ``n`` ids from place ``start`` on, counted over all documents; fewer at the end of the files.

    The offsets tell which blocks hold them; of no other block is the payload read. The ids come to the driver.
    """
    blocks = spark.read.parquet(path)
    at = F.col("base") + F.col("first")
    held = blocks.join(_offsets(blocks), "part").where((at < start + n) & (at + F.col("n_ids") > start))
    places = held.select("part", "block", at.alias("at")).orderBy("at").collect()
    out = [np.zeros(0, np.uint32)]
    for part, some in groupby(places, lambda r: r.part):
        known = {r.block: r.at for r in some}
        wanted = (F.col("part") == part) & F.col("block").between(min(known), max(known))
        for row in sorted(blocks.where(wanted).select("block", "n_ids", "bits", "payload").collect(), key=lambda r: r.block):
            low = max(0, start - known[row.block])
            high = min(row.n_ids, start + n - known[row.block])
            out.append(unpack(row.payload, high - low, row.bits, low))
    return np.concatenate(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, ids)`` of every document in the files; ``start`` counts all ids before it."""
    blocks = spark.read.parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                lengths = np.array(one.column("lengths")[0].as_py(), np.int64)
                n = one.column("n_ids")[0].as_py()
                ids = unpack(one.column("payload")[0].as_buffer(), n, one.column("bits")[0].as_py())
                ends = np.cumsum(lengths)
                starts = ends - lengths + one.column("first")[0].as_py() + one.column("base")[0].as_py()
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([one.column("doc_ids").values.slice(one.column("doc_ids").offsets[0].as_py(), len(lengths)), pa.array(starts), lists], ["doc_id", "start", "ids"])

    key = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.join(_offsets(blocks), "part").mapInArrow(documents, f"doc_id {key}, start long, ids array<int>")


def id_sums(df: DataFrame, name: str = "ids_crc32") -> DataFrame:
    """``df`` with ``ids`` replaced by the crc32 of the ids as little-endian unsigned 32-bit integers."""
    schema = fields([f for f in df.schema if f.name != "ids"], f"n_tokens long, {name} long")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            cuts = lists.offsets.to_numpy()
            ids = lists.values.to_numpy().astype("<u4")
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            rest = [batch.column(f) for f in batch.schema.names if f != "ids"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(cuts).astype(np.int64)), pa.array(sums, pa.int64())], schema.names)

    return df.mapInArrow(summed, schema)


def token_output(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Writes all documents to ``path`` (by default a new folder among the shared ones) and reads them back."""
    spark = docs.sparkSession
    if path is None:
        import uuid

        path = f"{scratch(spark)}/token-ids-{uuid.uuid4().hex}"
    write(docs, path, tokenizer or default_path(), end_id)
    return read(spark, path)


def query(docs: DataFrame) -> DataFrame:
    return id_sums(token_output(docs)).select("doc_id", "start", "n_tokens", "ids_crc32")
