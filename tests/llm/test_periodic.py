"""Periodic runs against a search of all periods, on random words, the small table and odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tiercurve.llm import periodic
from tiercurve.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_of(words, shortest=24, times=3):
    """``(start, end, period)`` of all runs: every period is tried at every place."""
    found = {}
    for q in range(1, len(words) // times + 1):
        start = 0
        for i in range(len(words) - q + 1):
            if i == len(words) - q or words[i] != words[i + q]:
                if i - start + q >= max(shortest, times * q):
                    found.setdefault((start, i + q), q)
                start = i + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def numbered(texts):
    cuts = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    return np.array([w for t in texts for w in t], np.uint64), cuts


@st.composite
def wordy(draw):
    words = draw(st.lists(st.integers(0, draw(st.sampled_from([0, 1, 2, 40]))), max_size=160))
    for _ in range(draw(st.integers(0, 3)) if len(words) > 30 else 0):
        at, q, n = draw(st.integers(0, len(words) - 1)), draw(st.integers(1, 50)), draw(st.integers(1, 160))
        for i in range(at + q, min(len(words), at + n)):
            words[i] = words[i - q]
    return words


@settings(max_examples=150, deadline=None)
@given(st.lists(wordy(), max_size=5))
def test_runs_of_random_words(texts):
    want = [(t, *r) for t, words in enumerate(texts) for r in runs_of(words)]
    assert [tuple(r) for r in periodic.runs(*numbered(texts)).tolist()] == want


@pytest.mark.parametrize("b", [8, 16, 64])
def test_occurrences_are_those_of_a_plain_comparison(b):
    words = np.random.default_rng(b).integers(0, 3, 700).astype(np.uint64)
    words[300:500] = words[210:410]
    place, distance = periodic.occurrences(words, b)
    lags = range(1 if b == periodic.BLOCK else b, 2 * b)
    want = {(p, d) for p in range(0, len(words) - b + 1, b) for d in lags if p + b + d <= len(words) and (words[p : p + b] == words[p + d : p + d + b]).all()}
    assert {*zip(place.tolist(), distance.tolist(), strict=True)} == want


def test_long_texts():
    same = np.zeros(60_000, np.uint64)
    assert periodic.runs(same, np.array([0, 60_000])).tolist() == [[0, 0, 60_000, 1]]
    same[30_000] = 1
    assert periodic.runs(same, np.array([0, 60_000])).tolist() == [[0, 0, 30_000, 1], [0, 30_001, 60_000, 1]]
    distinct = np.arange(20_000, dtype=np.uint64)
    wide = np.concatenate([distinct, distinct, distinct, distinct[:77]])
    assert periodic.runs(wide, np.array([0, len(wide)])).tolist() == [[0, 0, len(wide), 20_000]]


#: Eight differences whose squares add up to the modulus, so that a block looks like its copy.
DIFFERENCES = [15199, 15725, 16563, 15214, 15613, 15644, 18505, 14080]


def block_and_false_copy():
    distinct = list(range(18_520))
    return distinct + distinct[:8] + [i + d for i, d in enumerate(DIFFERENCES)]


def test_a_block_whose_only_copy_is_one_modulo_the_prime():
    assert sum(d * d for d in DIFFERENCES) == periodic.PRIME
    words = block_and_false_copy()
    place, distance = periodic.occurrences(np.array(words, np.uint64), 8)
    assert (place.tolist(), distance.tolist()) == ([18_520], [8])
    assert periodic.runs(*numbered([words])).tolist() == []
    assert periodic.runs(*numbered([words, [7] * 8, words + [3] * 30])).tolist() == [[2, len(words), len(words) + 30, 1]]


def test_query_with_a_false_copy(spark):
    free = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10)
    text = " ".join(f"w{i}" for i in block_and_false_copy())
    nothing, same = (hashlib.sha256(x.encode()).hexdigest() for x in ("", text))
    got = periodic.query(spark.createDataFrame([(free, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(free, 0, None, None, None, None, nothing, same)]


def test_only_runs_that_are_found_whole_are_promised():
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(9, np.uint64), np.array([0, 9]), times=2)


def expected(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs_of(words)
    best = max(found, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
    first = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    gone = {i for s, e, q in found for i in range(s + q, e)}
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(found, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *first, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_query_on_the_small_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = [expected(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in periodic.query(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[1] for r in want)


def test_odd_rows(spark):
    planted = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [
        (planted, "x" * 9), (planted, " ".join(f"w{i}" for i in range(500))), (1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (None, "ha " * 30), (4, "ha\n" * 30),
        (4, "ha\n" * 30), (5, "a b " * 11 + "a"), (6, "\x85a\u2003b " * 40), (7, "lol " * 50 + "end " + "lol " * 50), (planted, None), (planted, "  "),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit("r"), "n_words": F.lit("n"), "start": F.lit(1)})
    got = [tuple(r) for r in periodic.query(docs).collect()]
    assert sorted(got, key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert periodic.query(docs.where("false")).count() == 0
    kept = {r.doc_id: r for r in periodic.collapsed(docs.where("doc_id > 3 and doc_id < 8")).collect()}
    assert kept[4].text == "ha" and kept[4].start == 1 and [tuple(r) for r in kept[4].runs] == [(0, 30, 1)]
    assert kept[7].text == "lol end lol" and kept[7].n_words == 101
