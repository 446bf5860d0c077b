"""Conversation repair against an exhaustive search of edits, on random turns, the small table and odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tiercurve.llm import turns
from tiercurve.llm.common import table

BLACK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """Cost and audit of ``(initial, fault)`` rows by trying all edits; faults are 0 none, 1 truncated, 2 must go."""
    best = [2 * len(rows), ["D" * len(rows)]]

    def go(i, role, cost, audit, inserted):
        if cost > best[0]:
            return
        if i == len(rows) and role in ("", "a"):
            best[:] = [cost, [audit]] if cost < best[0] else [cost, [*best[1], audit]]
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, role, cost + 2, audit + "D", 0)
            if fault < 2:
                if initial == "s" and role == "":
                    go(i + 1, "s", cost + 5 * fault, audit + "K", 0)
                follows = "a" if role == "u" else "u"
                edit = "K" if initial == follows else "R"
                go(i + 1, follows, cost + 5 * fault + (edit == "R"), audit + edit, 0)
        if inserted < 2:
            go(i, "a" if role == "u" else "u", cost + 5, audit + "I", inserted + 1)

    go(0, "", 0, "", 0)
    return best[0], min(best[1])


ROW = st.tuples(st.sampled_from("suuaax"), st.sampled_from([0, 0, 0, 1, 2]))


def coded(rows):
    return bytes("suax".index(i) + 4 * f for i, f in rows)


@settings(max_examples=400, deadline=None)
@given(st.lists(ROW, max_size=8))
def test_cheapest_is_that_of_a_full_search(rows):
    assert turns.cheapest(coded(rows)) == cheapest(rows)


def test_a_plain_conversation_costs_nothing():
    assert turns.cheapest(coded([("s", 0), *[("u", 0), ("a", 0)] * 500])) == (0, "K" * 1001)


def test_long_conversations_are_traced_over_kept_rows():
    rows = [("u", 0), ("a", 0)] * 600
    rows[301:301] = [("x", 2)] * 3  # blank
    del rows[900]
    cost, audit = turns.cheapest(coded(rows))
    assert len(rows) > 10 * turns._Table(np.frombuffer(coded(rows), np.uint8).astype(np.int64)).block
    assert cost == 3 * 2 + 2 and audit.count("D") == 4 and audit.count("K") == len(rows) - 4


def expected(items):
    """Each conversation's row, from the damage on, for ``(conv_id, turn, role, text)`` rows."""
    conversations = defaultdict(list)
    for conv, turn, role, text in items:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = conversations[conv]
        if how:
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            role = "user" if how == 4 else role
            own += [(turn, role, text)] * (2 if how == 3 else 1)
    out = []
    for conv, rows in conversations.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        told = [r[0] for r in rows if r[0] is not None]
        gaps = max(told) - min(told) + 1 - len({*told}) if told else 0
        faults, seen = [], set()
        for _, role, text in rows:
            black = BLACK.findall(text)
            faults.append("blank" if not black else "duplicate" if (role, text) in seen else "" if black[-1] in ".!?" else "truncated")
            seen.add((role, text))
        firsts = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))
        weight = {"": 0, "truncated": 1, "blank": 2, "duplicate": 2}
        cost, audit = cheapest([(i, weight[f]) for i, f in zip(firsts, faults, strict=True)])
        lines, left, need = [], iter(rows), "user"
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(left)[1:]
            if edit == "D":
                continue
            system = edit == "K" and role[:1] == "s"
            lines.append(f"{role if edit == 'K' else need}:{text}")
            need = need if system else "assistant" if need == "user" else "user"
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_on_the_small_table(spark):
    conversations = table(spark, "/root/testdata/sf0.01", "conversations")
    want = expected([tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()])
    assert rows_of(turns.query(conversations)) == want
    assert {letter for r in want for letter in r[7]} == set("DKR")  # no insertion is cheaper than a deletion beside it


def gone(turn):
    """A conversation whose only row of that turn is dropped."""
    return next(c for c in range(1000) if zlib.crc32(f"{c}:{turn}".encode()) % 20 == 0)


def test_odd_rows(spark):
    items = [
        (1001, None, "user", "Hi."), (1001, None, None, None), (1001, 5, "assistant", "So?"), (1001, 2, "user", "x" * 200_000 + "!"), (None, 1, "user", "A."), (None, 2, "assistant", "B."),
        (None, None, "system", "S."), (gone(0), 0, "user", "Gone."), (gone(0) + 1000, None, "", ""), (1002, 1, "user", "Same."), (1002, 1, "user", "Same."), (1002, 1, "assistant", "Same."),
        (1003, 3, "tool", "T \x85"), (1003, 3, "assistant", "\t\n\x0b\x0c\r "), (1003, 9, "usr", "Ok.\u2003"), (1004, 1, "é", "é!  \n"), (1005, 1, "assistant", "No pair!"),
    ]
    df = spark.createDataFrame(items, "conv_id long, turn long, role string, text string")
    odd = df.withColumns({"audit": F.lit("x"), "digest": F.lit(1), "present": F.lit(False), "code": F.lit("c"), "summary": F.lit(2)})
    assert rows_of(turns.query(odd)) == expected(items)
    assert turns.query(odd.where("false")).count() == 0
    by_text = turns.query(odd.select(F.concat(F.lit("c"), "conv_id").alias("conv_id"), "turn", "role", "text"))
    assert by_text.count() == len({r[0] for r in items})


def test_repaired_turns(spark):
    items = [(1, 1, "system", "S."), (1, 2, "user", "Q?"), (1, 3, "user", "More."), (1, 4, "assistant", "A."), (2, 1, "user", ""), (3, 1, "assistant", "A."), (3, 2, "user", "B."), (3, 3, "assistant", "C.")]
    df = spark.createDataFrame(items, "conv_id long, turn long, role string, text string")
    got = rows_of(turns.repaired(df))
    assert [r for r in got if r[0] == 1] == [(1, 0, "K", "system", "S."), (1, 1, "K", "user", "More."), (1, 2, "K", "assistant", "A.")]
    assert [r[2:] for r in got if r[0] == 3] == [("K", "user", "B."), ("K", "assistant", "C.")]
    for conv, _, _, _, _, _, _, audit, digest in rows_of(turns.audited(df)):
        lines = "\n".join(f"{r[3]}:{r[4]}" for r in sorted(got) if r[0] == conv)
        assert hashlib.sha256(lines.encode()).hexdigest() == digest
        assert audit.replace("D", "") == "".join(r[2] for r in sorted(got) if r[0] == conv)
