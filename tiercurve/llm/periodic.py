"""Periodic runs of words, found by block convolution and taken out of the texts.

Words are parted by ASCII white space. A run is a stretch of consecutive words of one text with smallest period q
(words q apart are identical) and at least ``max(SHORTEST, TIMES * q)`` words, which no neighbouring word extends. All
runs of a whole text are found, whatever their period.

* *Scales.* For b = 8, 16, 32, ... the words are cut into blocks of b. A run of period q in [b, 2b) has 3q words or more,
  so it holds a whole block together with the block's copy q words on; periods under 8 do so at b = 8, where a run has
  24 words or more.
* *Convolution.* Words are numbers. The squared differences between a block and each place of the 2b words behind it
  are two sums of squares less twice a correlation, which an exact integer transform (NTT, modulo ``PRIME``) gives for all
  places at once. Each block is transformed once, padded to 2b: its own spectrum and those of the next two blocks yield the
  window's by one addition. Where the sum is zero modulo ``PRIME`` the block occurs again; nothing that occurs is missed.
* *Extension.* Such distances seed runs. Blocks in a row with one distance are joined and extended on both sides by
  less than a block, with prefix hashes; a stretch that is long enough is then compared word by word. Seeds within a
  known run whose period divides their distance say nothing new and go first.

A text is worked on by one task and texts of about a megabyte together, without a shuffle; a longer text is worked on
alone, in tiles of about ``TILE`` words a transform (the modulus allows 400 million words). A null text has no words and
becomes empty; empty texts have no run. Repeated rows are treated each by itself, an empty table gives no rows, and
columns named as results are replaced. A null id plants nothing in ``query``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiercurve.llm.common import Prefix, fields, mix, text_chunks

SHORTEST, TIMES = 24, 3
BLOCK, TILE = 8, 1 << 15
PRIME, GENERATOR = 2013265921, 31  # 15 * 2**27 + 1 and a primitive root of it
_P = np.uint64(PRIME)
_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _reduced(x: np.ndarray) -> np.ndarray:
    return x - x // _P * _P


@lru_cache(maxsize=64)
def _roots(size: int, inverse: bool) -> np.ndarray:
    """The first ``size / 2`` powers of a root of unity of order ``size``."""
    step = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    powers = np.ones(size // 2, np.uint64)
    have, factor = 1, pow(step, -1, PRIME) if inverse else step
    while have < len(powers):
        powers[have : 2 * have] = _reduced(powers[:have] * np.uint64(pow(factor, have, PRIME)))
        have *= 2
    return powers


@lru_cache(maxsize=64)
def _negated(size: int) -> np.ndarray:
    """Where the spectrum of the opposite frequency stands, in the order ``_forward`` leaves."""
    order = np.zeros(1, np.int64)
    while len(order) < size:
        order = np.concatenate([2 * order, 2 * order + 1])
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    return place[-order % size]


def _forward(rows: np.ndarray) -> np.ndarray:
    """The transform of each row, in bit-reversed order."""
    n, size = rows.shape
    half = size // 2
    while half:
        pairs = rows.reshape(n, -1, 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1]
        added = _reduced(low + high)
        pairs[:, :, 1] = _reduced((low + _P - high) * _roots(2 * half, False))
        pairs[:, :, 0] = added
        half //= 2
    return rows


def _backward(rows: np.ndarray) -> np.ndarray:
    """``size`` times the rows whose transforms these are."""
    n, size = rows.shape
    half = 1
    while half < size:
        pairs = rows.reshape(n, -1, 2, half)
        low, turned = pairs[:, :, 0], _reduced(pairs[:, :, 1] * _roots(2 * half, True))
        difference = _reduced(low + _P - turned)
        pairs[:, :, 0] = _reduced(low + turned)
        pairs[:, :, 1] = difference
        half *= 2
    return rows


def occurrences(words: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """``(place, distance)`` of blocks of ``b`` numbers that occur again ``distance`` places on.

    Distances are from ``b`` to ``2 b - 1``, for the smallest blocks from 1.
    """
    n = len(words)
    blocks = n // b
    padded = np.zeros((blocks + 3) * b, np.uint64)
    padded[:n] = words
    squares = np.zeros(len(padded) + 1, np.uint64)
    np.cumsum(_reduced(padded * padded), out=squares[1:])
    minus, tile = _negated(2 * b), max(4, TILE // b)
    places, distances = [], []
    for first in range(0, blocks, tile):
        some = min(tile, blocks - first)
        own = np.zeros((some + 2, 2 * b), np.uint64)
        own[:, :b] = _reduced(padded[first * b : (first + some + 2) * b]).reshape(-1, b)
        spectra = _forward(own)
        opposite = spectra[:some, minus]
        start = (first + np.arange(some))[:, None] * b
        block = squares[start + b] - squares[start]
        for ahead in (0, 1) if b == BLOCK else (1,):
            left, right = spectra[ahead : some + ahead], spectra[ahead + 1 : some + ahead + 1]
            window = np.concatenate([left[:, :b] + right[:, :b], left[:, b:] + _P - right[:, b:]], axis=1)
            common = _backward(_reduced(_reduced(window) * opposite))[:, :b]
            at = start + ahead * b + np.arange(b)
            total = _reduced(block + squares[at + b] - squares[at])
            # The transforms are 2 b times too great, and the correlation counts twice.
            row, lag = np.nonzero(_reduced(total * np.uint64(b)) == common)
            places.append((first + row) * b)
            distances.append(lag + ahead * b)
    place, distance = np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *distances])
    inside = (distance > 0) & (place + b + distance <= n)
    return place[inside], distance[inside]


def _alike(prefix: Prefix, a: np.ndarray, b: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
    """How many words agree from places ``a`` and ``b`` on, or before them, up to ``limit``, by their hashes."""
    low, high = np.zeros(len(a), np.int64), limit.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        agree = prefix(a - middle, a) == prefix(b - middle, b) if back else prefix(a, a + middle) == prefix(b, b + middle)
        low, high = np.where(agree, middle, low), np.where(agree, high, middle - 1)
    return low


def _known(place: np.ndarray, distance: np.ndarray, b: int, runs: np.ndarray) -> np.ndarray:
    """Whether block and copy lie in one of ``runs`` ``(start, end, period)`` whose period divides the distance."""
    known = np.zeros(len(place), bool)
    for start, end, period in runs[runs[:, 1] - runs[:, 0] >= 2 * b].tolist():
        low, high = np.searchsorted(place, [start, end])
        own = slice(low, high)
        known[own] |= (place[own] + b + distance[own] <= end) & (distance[own] % period == 0)
    return known


def _stretches(words: np.ndarray, start: int, end: int, period: int) -> list[tuple[int, int, int]]:
    """The stretches of that period with ends in ``words[start:end]``, compared word by word."""
    equal = np.concatenate([[False], words[start : end - period] == words[start + period : end], [False]])
    edges = np.flatnonzero(equal[1:] != equal[:-1]).reshape(-1, 2) + start
    return [(s, e + period, period) for s, e in edges.tolist()]


def _runs_of_scale(words: np.ndarray, b: int, known: np.ndarray, shortest: int, times: int) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of runs with a period in the scale of ``b``; some have a smaller period as well."""
    place, distance = occurrences(words, b)
    order = np.argsort(place, kind="stable")
    place, distance = place[order], distance[order]
    fresh = ~_known(place, distance, b, known)
    place, distance = place[fresh], distance[fresh]
    if not len(place):
        return []
    prefix = Prefix(mix(words), 0x9E3779B97F4A7C15)
    same = prefix(place, place + b) == prefix(place + distance, place + distance + b)
    place, distance = place[same], distance[same]
    if not len(place):  # differences that are zero modulo PRIME alone
        return []
    order = np.lexsort((place, distance))
    place, distance = place[order], distance[order]
    first = np.append(True, (distance[1:] != distance[:-1]) | (place[1:] != place[:-1] + b))[: len(place)]
    start, period = place[first], distance[first]
    end = place[np.append(np.flatnonzero(first)[1:], len(place)) - 1] + b
    least = np.maximum(shortest, times * period)
    able = end - start + 2 * (b - 1) + period >= least
    start, end, period, least = start[able], end[able], period[able], least[able]
    left = _alike(prefix, start, start + period, np.minimum(start, b), True)
    right = _alike(prefix, end, end + period, np.minimum(len(words) - period - end, b), False)
    start, end = start - left, end + right + period
    long = end - start >= least
    out = []
    for run in {*zip(start[long].tolist(), end[long].tolist(), period[long].tolist(), strict=True)}:
        exact = _stretches(words, *run)
        out += [r for r in exact if r[1] - r[0] >= max(shortest, times * r[2])]
    return out


def runs(words: np.ndarray, cuts: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> np.ndarray:
    """``(text, start, end, period)`` of all runs of some texts, by text, start and period.

    ``words`` are the words' numbers (equal words, equal numbers), those of text t from ``cuts[t]`` to ``cuts[t + 1]``.
    A run has ``times`` (3 or more) periods and ``shortest`` (``3 * BLOCK`` or more) words at least.
    """
    if times < TIMES or shortest < SHORTEST:
        raise ValueError(f"runs of fewer than {TIMES} periods or {SHORTEST} words are not found")
    counts = np.diff(cuts)
    found: dict[tuple[int, int, int], int] = {}
    b = BLOCK
    while len(chosen := np.flatnonzero(counts >= max(times * b, shortest))):
        # The texts long enough for this scale, one after another, with a number of its own after each.
        sizes = counts[chosen] + 1
        begins = np.cumsum(sizes) - sizes
        joined = np.empty(sizes.sum(), np.uint64)
        ends = begins + sizes - 1
        inside = np.ones(len(joined), bool)
        inside[ends] = False
        joined[inside] = words[np.repeat(cuts[chosen] - begins, sizes)[inside] + np.flatnonzero(inside)] + len(chosen) + 1
        joined[ends] = np.arange(1, len(chosen) + 1)
        place = dict(zip(chosen.tolist(), begins.tolist(), strict=True))
        known = [(place[t] + s, place[t] + e, q) for (t, s, e), q in found.items() if t in place]
        for start, end, period in _runs_of_scale(joined, b, np.array(known, np.int64).reshape(-1, 3), shortest, times):
            text = int(np.searchsorted(begins, start, "right")) - 1
            key = (int(chosen[text]), start - int(begins[text]), end - int(begins[text]))
            found[key] = min(period, found.get(key, period))
        b *= 2
    return np.array(sorted((*key, period) for key, period in found.items()), np.int64).reshape(-1, 4)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where each text's begin and end."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    parts, cuts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(parts), 0)  # white space at an end of a text leaves an empty part
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    return parts.filter(real), before[cuts - cuts[0]]


def collapsed(docs: DataFrame, shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """``docs`` with ``text`` collapsed: of every run only the first period stays; words are joined by one space.

    Adds ``n_words``, and ``runs``: start (word number from 0), length and period of each, by start and period.
    A word goes if any run holds it after that run's first period.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("text", "n_words", "runs")]
    schema = fields(kept, f"text string, n_words long, runs array<{_RUN}>")

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, _, _ in text_chunks(batch):
                words, cuts = _words(batch.column("text").slice(first, end - first))
                numbers = words.dictionary_encode().indices.to_numpy().astype(np.uint64)
                found = runs(numbers, cuts, shortest, times)
                edges = np.zeros(len(words) + 1, np.int64)
                begin = cuts[found[:, 0]]
                np.add.at(edges, begin + found[:, 1] + found[:, 3], 1)
                np.add.at(edges, begin + found[:, 2], -1)
                keep = np.cumsum(edges[:-1]) == 0
                left = pa.array(np.append(0, np.cumsum(keep))[cuts], pa.int32())
                text = pc.binary_join(pa.ListArray.from_arrays(left, words.filter(pa.array(keep))), " ")
                each = np.searchsorted(found[:, 0], np.arange(end - first + 1))
                parts = [pa.array(found[:, 1]), pa.array(found[:, 2] - found[:, 1]), pa.array(found[:, 3])]
                lists = pa.ListArray.from_arrays(pa.array(each, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
                rest = [batch.column(batch.schema.get_field_index(f.name)).slice(first, end - first) for f in kept]
                yield pa.RecordBatch.from_arrays([*rest, text, pa.array(np.diff(cuts)), lists], schema.names)

    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col("text")).mapInArrow(collapse, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``; a tenth of the texts, chosen and shaped by crc32 of the id, get words repeated from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    g = F.floor(h / 10)
    numbered = docs.select("doc_id", "text", words.alias("_words"), g.alias("_g"))
    n = F.size("_words")
    placed = numbered.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    placed = placed.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))

    def word(_: Column, i: Column) -> Column:
        a, p = F.col("_a"), F.col("_p")
        return F.get("_words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))

    planted = F.array_join(F.transform("_words", word), " ")
    return placed.select("doc_id", F.when(F.col("_a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def query(docs: DataFrame) -> DataFrame:
    """The runs of every text, some of them planted, as digests and the run of the greatest exponent."""
    found = collapsed(with_planted_runs(docs))

    def greater(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    best = F.reduce("runs", F.lit(None).cast(_RUN), greater)
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select("*", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[name].alias(name) for name in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
