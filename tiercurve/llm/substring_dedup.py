"""Repeated passages: every word covered by a window of 35 words that starts anywhere else too is removed.

Documents are dealt into shards by a hash; a shard is worked on by one task and holds about ``SHARD``
characters, whatever the corpus. Three passes, each with one row per shard and value at most, so that a
passage in a third of all documents is as many rows as there are shards:

1. *Phrases.* In every window the phrase of ``PHRASE`` words with the least hash is its anchor; equal windows
   have equal anchors. Shards report their anchors with the hash of the run of windows around each.
   An anchor met twice recurs. If all its runs are alike, so do all windows of the run; else
2. *windows* around it are counted by 128-bit hash over all shards; those met twice recur.
3. *Automata.* Each shard compiles the phrases confirmed for it into an Aho-Corasick automaton and streams its
   documents through. It alone locates the anchors, by the words themselves, and tells which recur with their whole
   run; of the others the windows that recur by 2 cover their words.

Words are parted by ASCII white space and otherwise unchanged. A null text has no words. Repeated rows count as
documents of their own: each removes the other's passages. A text of fewer than 35 words is kept whole. An empty table
gives no rows. A text of up to 2**28 words is worked on as a whole, longer ones are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiercurve.llm.common import SPACED, Words, fields, grams, mix, text_chunks

WINDOW, PHRASE, SHARD = 35, 8, 4 << 20
_PLACE = 28  # bits for a place within a chunk, below the bits of a hash


class Anchored:
    """The windows of some documents and the anchors of their runs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, phrase: int):
        self.words = words = Words(data, offsets, SPACED)
        self.window, self.phrase = window, phrase
        hashes = words.hashes()
        self.grams = grams(hashes)
        self.again = grams(mix(hashes + np.uint64(0x5851F42D4C957F2D)), 0xD6E8FEB86659FD93)
        self.start = words.gram_starts(window)
        if not len(self.start):
            self.anchor = self.first = self.size = self.phrases = self.runs = self.runs_again = np.zeros(0, np.int64)
            return
        n = len(words.start)
        if n >= 1 << _PLACE:
            raise ValueError(f"a text of {n} words; at most {(1 << _PLACE) - 1} are numbered")
        at = np.arange(n - phrase + 1)
        found = self.grams(at, at + phrase)
        rank = (found & ~np.uint64((1 << _PLACE) - 1)) | at.astype(np.uint64)
        width, span = 1, window - phrase + 1
        while 2 * width <= span:
            rank = np.minimum(rank[:-width], rank[width:])
            width *= 2
        rank = np.minimum(rank[: len(rank) - (span - width)], rank[span - width :])
        anchors = (rank[self.start] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        new = np.flatnonzero(np.diff(anchors, prepend=-1) | (np.diff(self.start, prepend=-2) != 1))
        self.anchor, self.first = anchors[new], self.start[new]
        self.size = np.diff(np.append(new, len(anchors)))
        self.phrases = found[self.anchor]
        shape = mix(((self.anchor - self.first) * 1000 + self.size).astype(np.uint64))
        ends = self.first + self.size + window - 1
        self.runs, self.runs_again = (mix(g(self.first, ends) ^ shape) for g in (self.grams, self.again))

    def windows(self, some: np.ndarray) -> np.ndarray:
        """Starts of all windows in the runs ``some``."""
        size = self.size[some]
        return np.repeat(self.first[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def keys(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = starts + self.window
        return self.grams(starts, ends).view(np.int64), self.again(starts, ends).view(np.int64)


def _chunks(texts: pa.Table, window: int, phrase: int) -> Iterator[tuple[int, int, pa.RecordBatch, Anchored]]:
    for batch in texts.to_batches():
        for first, end, data, offsets in text_chunks(batch):
            yield first, end, batch, Anchored(data, offsets, window, phrase)


def _counted(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct rows of integer columns, and how often each occurs."""
    order = np.lexsort(columns)
    rows = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in rows:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [*(c[first] for c in rows), np.diff(np.append(first, len(order)))]


def _together(parts: list[list[np.ndarray]], n: int) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in range(n)]


def _reduced(merge: np.ufunc, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return merge.reduceat(values, first) if len(first) else values


def sharded(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """``(doc_id, text, shard)``, about ``shard`` characters in each."""
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = -(-total // shard) or 1
    return docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))


def without_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard: int = SHARD) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``; ``kept`` is the words left, joined by one space."""
    dealt = sharded(docs, shard)
    number = dealt.schema["shard"]

    def phrases(key: tuple, texts: pa.Table) -> pa.Table:
        found = [[x.view(np.int64) for x in (a.phrases, a.runs, a.runs_again)] for *_, a in _chunks(texts, window, phrase) if len(a.first)]
        h, *runs = _together(found, 3)
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        columns = {"shard": pa.array(np.full(len(first), key[0].as_py(), np.int32)), "phrase": h[first], "n": np.diff(np.append(first, len(h)))}
        for name, run in zip(("one", "two"), runs, strict=True):
            columns |= {f"low_{name}": _reduced(np.minimum, run[order], first), f"high_{name}": _reduced(np.maximum, run[order], first)}
        return pa.table(columns)

    anchors = dealt.groupBy("shard").applyInArrow(phrases, fields([number], "phrase long, n long, low_one long, high_one long, low_two long, high_two long"))
    by_phrase = Window.partitionBy("phrase")  # a row of each shard at most
    alike = [F.min(f"low_{k}").over(by_phrase) == F.max(f"high_{k}").over(by_phrase) for k in ("one", "two")]
    recurring = anchors.select("shard", "phrase", F.sum("n").over(by_phrase).alias("times"), (alike[0] & alike[1]).alias("whole")).where("times > 1").drop("times")

    def windows(key: tuple, texts: pa.Table, wanted: pa.Table) -> pa.Table:
        partial = np.unique(wanted["phrase"].to_numpy()[~wanted["whole"].to_numpy(zero_copy_only=False).astype(bool)])
        found = []
        for *_, a in _chunks(texts, window, phrase) if len(partial) else ():
            if len(a.first):
                found.append(list(a.keys(a.windows(np.flatnonzero(np.isin(a.phrases.view(np.int64), partial))))))
        one, two, n = _counted(_together(found, 2))
        return pa.table({"shard": pa.array(np.full(len(one), key[0].as_py(), np.int32)), "one": one, "two": two, "n": n})

    of_shard = dealt.groupBy("shard")
    met = of_shard.cogroup(recurring.groupBy("shard")).applyInArrow(windows, fields([number], "one long, two long, n long"))
    twice = met.withColumn("times", F.sum("n").over(Window.partitionBy("one", "two"))).where(F.col("times") > 1)
    no = F.lit(None).cast("long")
    confirmed = recurring.select("shard", "phrase", "whole", no.alias("one"), no.alias("two")).unionAll(
        twice.select("shard", no, F.lit(None).cast("boolean"), "one", "two")
    )

    def kept(key: tuple, texts: pa.Table, wanted: pa.Table) -> pa.Table:
        is_phrase = wanted["phrase"].is_valid().to_numpy()
        named = wanted.filter(pa.array(is_phrase))
        spans = wanted.filter(pa.array(~is_phrase))
        known = np.sort(named["phrase"].to_numpy())
        whole = known[np.isin(known, named["phrase"].to_numpy()[named["whole"].to_numpy(zero_copy_only=False).astype(bool)])]
        pairs = np.empty(len(spans), [("one", np.int64), ("two", np.int64)])
        pairs["one"], pairs["two"] = spans["one"].to_numpy(), spans["two"].to_numpy()
        pairs.sort()
        automaton = _automaton(texts, known, whole, window, phrase)
        out = []
        for first, end, batch, a in _chunks(texts, window, phrase):
            words = a.words
            edges = np.zeros(len(words.start) + 1, np.int64)
            if automaton is not None and len(a.first):
                places, wholly = _occurrences(automaton, words, phrase)
                located, entire = np.isin(a.anchor, places), np.isin(a.anchor, places[wholly])
                np.add.at(edges, a.first[entire], 1)
                np.add.at(edges, a.first[entire] + a.size[entire] + window - 1, -1)
                starts = a.windows(np.flatnonzero(located & ~entire))
                own = np.empty(len(starts), pairs.dtype)
                own["one"], own["two"] = a.keys(starts)
                place = np.searchsorted(pairs["one"], own["one"])
                again = np.zeros(len(own), bool)
                live = np.flatnonzero(place < len(pairs))
                while len(live):  # several windows can share the first half of a hash
                    same = pairs["one"][place[live]] == own["one"][live]
                    live = live[same]
                    again[live] |= pairs["two"][place[live]] == own["two"][live]
                    place[live] += 1
                    live = live[(place[live] < len(pairs)) & ~again[live]]
                np.add.at(edges, starts[again], 1)
                np.add.at(edges, starts[again] + window, -1)
            gone = np.cumsum(edges[:-1]) > 0
            data = words.data.tobytes()
            left, removed = [], []
            for k in range(end - first):
                a0, b0 = words.first[k], words.first[k + 1]
                stay = np.flatnonzero(~gone[a0:b0]) + a0
                left.append(b" ".join([data[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]))
                removed.append(int(b0 - a0) - len(stay))
            columns = [batch.column("doc_id").slice(first, end - first), pa.array(words.counts()), pa.array(removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())]
            out.append(pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"]))
        return pa.Table.from_batches(out)

    schema = fields([dealt.schema["doc_id"]], "n_words long, n_removed long, kept string")
    return of_shard.cogroup(confirmed.groupBy("shard")).applyInArrow(kept, schema)


def _automaton(texts: pa.Table, known: np.ndarray, whole: np.ndarray, window: int, phrase: int):
    """The automaton of the shard's confirmed phrases, and for each whether its whole runs recur.

    Phrases are their UTF-8 bytes as characters, words between spaces.
    """
    automaton = ahocorasick.Automaton()
    seen: set[int] = set()
    entire = {*whole.tolist()}
    for *_, a in _chunks(texts, window, phrase) if len(known) else ():
        if not len(a.first):
            continue
        named, at = np.unique(a.phrases.view(np.int64), return_index=True)
        for h, k in zip(named.tolist(), at.tolist(), strict=True):
            if h not in seen and known[min(np.searchsorted(known, h), len(known) - 1)] == h:
                seen.add(h)
                automaton.add_word(" " + a.words.text(a.anchor[k], a.anchor[k] + phrase).decode("latin-1") + " ", h in entire)
    if not seen:
        return None
    automaton.make_automaton()
    return automaton


def _occurrences(automaton, words: Words, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all occurrences of the automaton's phrases, and whether their whole runs recur."""
    places, wholly = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        text = b" " + words.text(a, b) + b" "
        met = [*automaton.iter(text.decode("latin-1"))]
        if met:
            spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
            places.append(a + np.searchsorted(spaces, [end for end, _ in met]) - phrase)
            wholly.append(np.array([entire for _, entire in met], bool))
    return np.concatenate(places), np.concatenate(wholly)


def query(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
