"""Benchmark decontamination: windows of ten normalised words that also occur in a benchmark.

Words are runs of ASCII letters and digits and of characters above 127, A-Z in lower case. Every ``WINDOW`` words
of an item are a window; a shorter item with words is one window. The hashes of the benchmark's windows are broadcast in
chunks of at most ``CHUNK_WINDOWS`` windows (benchmarks need one; a larger one takes a scan for each chunk, so
the broadcast never grows with it). Each document's windows are looked up with numpy, and every hit
is verified on the words themselves before it counts.

A null text or item has no words. An item without an id still hits, but is not listed. Items with the
same text are listed each; repeated ``item_id`` count once. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiercurve.llm.common import Words, byte_set, fields, grams, text_chunks, written

WINDOW = 10
CHUNK_WINDOWS = 500_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
WORD_BYTES = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(LOWER[data], offsets, WORD_BYTES)


def _windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all windows of ``n`` words."""
    starts = words.gram_starts(n)
    return starts, grams(words.hashes())(starts, starts + n)


def _item_windows(n: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("item_id")
            for first, end, data, offsets in text_chunks(batch):
                words = words_of(data, offsets)
                sizes = words.counts()
                rows, lengths, texts = [], [], []
                for k in range(end - first):
                    width = min(n, sizes[k])
                    for at in range(words.first[k], words.first[k + 1] - width + 1) if width else ():
                        rows.append(first + k)
                        lengths.append(width)
                        texts.append(words.text(at, at + width))
                columns = [items.take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int32()), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "length", "window"])

    return windows


class Index:
    """Windows by length and hash, with their words and items."""

    def __init__(self, rows: list[tuple[str | None, int, bytes]]):
        items: dict[tuple[int, bytes], set[str]] = defaultdict(set)
        for item, length, window in rows:
            items[(length, bytes(window))].update([] if item is None else [item])
        self.items = dict(items)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {length for length, _ in items}:
            joined = [w for length, w in items if length == n]
            data = np.frombuffer(b"".join(joined), np.uint8)
            words = words_of(data, np.cumsum([0, *map(len, joined)]))
            hashes = np.unique(_windows(words, n)[1])
            flags = np.zeros(1 << 20, bool)
            flags[hashes & np.uint64((1 << 20) - 1)] = True
            self.by_length[n] = hashes, flags

    def hits(self, words: Words) -> Iterator[tuple[int, int, set[str]]]:
        """``(first word, words, items)`` of every verified window."""
        prefix = grams(words.hashes())
        for n, (hashes, flags) in self.by_length.items():
            starts = words.gram_starts(n)
            found = prefix(starts, starts + n)
            maybe = np.flatnonzero(flags[found & np.uint64(len(flags) - 1)])
            maybe = maybe[np.isin(found[maybe], hashes)]
            for at in starts[maybe].tolist():
                items = self.items.get((n, words.text(at, at + n)))
                if items is not None:
                    yield at, n, items


def _marked(docs: DataFrame, index: Index) -> DataFrame:
    """``docs`` with the hits of ``index`` added: bits of hit words and the items met."""
    shared, names = docs.sparkSession.sparkContext.broadcast(index), docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            before, known = batch.column("hit_bits").to_pylist(), batch.column("items").to_pylist()
            counts, bits, items = [], [], []
            for first, end, data, offsets in text_chunks(batch):
                words = words_of(data, offsets)
                hit = np.zeros(len(words.start), bool)
                met: dict[int, set[str]] = defaultdict(set)
                for at, n, which in own.hits(words):
                    hit[at : at + n] = True
                    met[int(np.searchsorted(words.first, at, "right")) - 1].update(which)
                for k in range(end - first):
                    flags = hit[words.first[k] : words.first[k + 1]]
                    if before[first + k] is not None:
                        flags = flags | np.unpackbits(np.frombuffer(before[first + k], np.uint8), count=len(flags)).astype(bool)
                    counts.append(len(flags))
                    bits.append(np.packbits(flags).tobytes() if flags.any() else None)
                    items.append(sorted(met[k].union(known[first + k] or ())) if k in met or known[first + k] else None)
            columns = {"n_words": pa.array(counts, pa.int64()), "hit_bits": pa.array(bits, pa.binary()), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(n)) for n in names], names)

    return docs.mapInArrow(scan, docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_windows: int = CHUNK_WINDOWS) -> DataFrame:
    """``docs`` and ``n_words``, ``hit_bits`` and ``items``; ``hit_bits`` has a bit for each word, null if none is hit.

    ``docs`` must not have these three names itself (see ``folded``).
    """
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    windows = items.mapInArrow(_item_windows(window), "item_id string, length int, window binary").distinct()
    chunks = max(1, -(-windows.count() // chunk_windows))
    marked = docs.select(
        "*", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hit_bits"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    for k in range(chunks):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(chunks)) == k).collect()  # about chunk_windows rows
        marked = _marked(marked, Index([tuple(r) for r in rows]))
        if k + 1 < chunks:
            marked = written(marked)
    return marked


def without_hits(marked: DataFrame, name: str = "text") -> DataFrame:
    """``marked`` with the bytes of hit words, and what lies between two of them, taken out of its text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(name).to_pylist()
            for k, bits in enumerate(batch.column("hit_bits").to_pylist()):
                if bits is None:
                    continue
                raw = texts[k].encode()
                words = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                flags = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words.start))
                edges = np.diff(np.concatenate([[0], flags, [0]]).astype(int))
                kept, last = [], 0
                for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
                    kept.append(raw[last : words.start[a]])
                    last = words.end[b - 1]
                texts[k] = b"".join([*kept, raw[last:]]).decode(errors="ignore")
            columns = [pa.array(texts, pa.string()) if n == name else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return marked.mapInArrow(cut, marked.schema)


def _counted(marked: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [0 if b is None else int.from_bytes(b, "big").bit_count() for b in batch.column("hit_bits").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.int64())], [*batch.schema.names, "n_hit"])

    return marked.mapInArrow(count, fields(marked.schema.fields, "n_hit long"))


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    items = F.coalesce("items", F.array().cast("array<string>"))
    return _counted(contamination(docs.select("doc_id", "text"), benchmark).drop("text")).select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
