"""Packing by a plan over the histogram of lengths: best fit, longest first, on counts instead of documents.

Documents longer than a sequence are cut into pieces of full length; the last may be shorter. Only the
counts by length (at most ``size`` numbers) go to the driver, which plans there: for each length, from
the longest, sequences with the least sufficient room are filled first, whole ranges of alike sequences at once.
The plan lists, for each length, ranges of ranks and the sequences and places they take. Each piece then
takes its slot by its rank within its length. The rank is its place among the pieces of its length in
its task, plus the sum over the tasks before; no task ranks all pieces of one length. Where only digests of the ids
are wanted, as in ``query``, they are made where the ids are, and the ids themselves are neither kept nor shuffled.

Null and empty texts are the end id alone. Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiercurve.llm.common import fields, trimmed, written
from tiercurve.llm.tokens import REMEMBERED, default_path, encoder, groups, with_end

SIZE = 2048


def plan(histogram: dict[int, int], size: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, ``(first rank, pieces in a sequence, first sequence, offset)`` of its ranges of ranks.

    The piece of rank r in a range is in sequence ``first sequence + (r - first rank) // pieces``, at
    ``offset + length * ((r - first rank) % pieces)``.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # by room left: ranges of sequences (first, how many)
    rooms: list[int] = []  # its keys in order
    opened = 0
    out: dict[int, list[tuple[int, int, int, int]]] = {}

    def keep(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        count, rank, slots = histogram[length], 0, []
        while count:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # no room anywhere: new sequences, with as many pieces as they hold
                each = min(size // length, count)
                n = count // each
                left, first = size, opened
                opened += n
            else:
                left = rooms[at]
                first, there = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
                each = min(left // length, count)
                n = min(there, count // each)
                keep(left, first + n, there - n)
            slots.append((rank, each, first, size - left))
            keep(left - each * length, first, n)
            rank += n * each
            count -= n * each
        out[length] = slots
    return out


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, digests: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """``(doc_id, piece, start, length, ids, task, place)``; ``place`` counts the pieces of its length in its task.

    With ``digests`` there is ``ids_crc32`` instead of ``ids``: of the ids as little-endian unsigned 32-bit integers.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode = TaskContext.get().partitionId(), encoder(tokenizer, remembered)
        seen: Counter[int] = Counter()
        for batch in batches:
            for row, texts in groups(batch.column("text")):
                ids, cuts = with_end(*encode(texts), end_id)
                parts = -(-np.diff(cuts) // size)
                owner = np.repeat(np.arange(len(texts)), parts)
                number = np.arange(len(owner)) - (np.cumsum(parts) - parts)[owner]
                start = number * size
                length = np.minimum(size, np.diff(cuts)[owner] - start)
                places = np.empty(len(owner), np.int64)
                order = np.argsort(length, kind="stable")
                kinds, first, counts = np.unique(length[order], return_index=True, return_counts=True)
                places[order] = np.arange(len(owner)) - np.repeat(first - np.array([seen[k] for k in kinds.tolist()]), counts)
                seen.update(dict(zip(kinds.tolist(), counts.tolist(), strict=True)))
                ends = np.append(0, np.cumsum(length))
                if digests:
                    raw = memoryview(ids.astype("<u4")).cast("B")
                    content = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())
                else:
                    content = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                columns = [
                    batch.column("doc_id").slice(row, len(texts)).take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(start),
                    pa.array(length), content, pa.array(np.full(len(owner), task, np.int32)), pa.array(places),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    ddl = "ids_crc32 long" if digests else "ids array<int>"
    schema = fields([docs.schema["doc_id"]], f"piece int, start long, length long, {ddl}, task int, place long")
    return docs.select("doc_id", "text").mapInArrow(lambda batches: trimmed(cut(batches)), schema)


def pack(
    docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = 0, digests: bool = False, remembered: int = REMEMBERED
) -> DataFrame:
    """``(doc_id, piece, start, length, sequence_id, offset, ids)``, a row for each piece; ``ids_crc32`` for ``ids`` if ``digests``.

    Workers keep what they remember of the tokens of at most ``remembered`` words, also for other jobs they run later.
    """
    cut = written(pieces(docs, tokenizer or default_path(), size, end_id, digests, remembered))
    content = cut.schema[4]
    counts = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``size`` rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    planned = docs.sparkSession.sparkContext.broadcast(
        {length: [np.array(x, np.int64) for x in zip(*slots, strict=True)] for length, slots in plan(histogram, size).items()}
    )
    schema = fields([docs.schema["doc_id"]], "piece int, start long, length long, sequence_id long, offset long").add(content)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = planned.value
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("base").to_numpy() + batch.column("place").to_numpy()
            sequences, offsets = np.empty_like(ranks), np.empty_like(ranks)
            for length in np.unique(lengths):
                own = lengths == length
                first, each, sequence, offset = slots[int(length)]
                at = np.searchsorted(first, ranks[own], "right") - 1
                within = ranks[own] - first[at]
                sequences[own] = sequence[at] + within // each[at]
                offsets[own] = offset[at] + length * (within % each[at])
            rest = {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", content.name)}
            rest |= {"sequence_id": pa.array(sequences), "offset": pa.array(offsets)}
            yield pa.RecordBatch.from_arrays([rest[n] for n in schema.names], schema.names)

    return cut.join(bases, ["length", "task"]).mapInArrow(lambda batches: trimmed(placed(batches)), schema)


def query(docs: DataFrame) -> DataFrame:
    return pack(docs, digests=True).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
