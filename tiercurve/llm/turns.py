"""Repair of the structure of conversations, at least cost, with an audit of the edits.

The roles of a conversation should read ``(s?(ua)+)?`` by their first letters: perhaps a system turn, then user and assistant
in turn, or nothing. Rows are taken by turn (nulls first; rows of one turn by a digest of role and text, so that equal rows are
neighbours). The first fault of a row counts: blank (no character but ASCII white space), duplicate (role and text
seen earlier in the conversation), truncated (the last such character is not one of ``.!?``). Edits and their costs:

* Keep 0; Rerole 1, to user or assistant; Delete 2, a must for blank and duplicate rows; Insert 5, an empty turn of user
  or assistant, anywhere. A truncated row that is not deleted adds 5.

The audit is the initials of the cheapest edits in order, the least in ASCII order of several. Whether a system turn leads
and how many pairs follow is fixed by it, and so is every role.

* *Alignment.* The rows are aligned, as by Wagner and Fischer, with each target ``(ua)*`` and ``s(ua)+``. The alternating targets
  are ends of one another, so one table of the costs from each row on, by the length that is left, holds them all.
* *Bands.* Two greedy repairs give a cost to beat. What it costs above the unavoidable deletions bounds, as in Ukkonen's
  method, how far the length left may be from the number of clean rows left; only that band is computed.
* *Audits.* Every target of the least cost is traced along the least edit that keeps its cost; the least audit wins. Long tables
  are kept at every so many rows, and the rows between computed again.

Two passes read the rows in order, without holding a conversation: the first keeps two bytes and a digest a row and yields counts
and audit, the second applies the audit to roles and texts as they stream by. The table of a conversation of n rows takes
time n times its band, whose width grows with the faults in it.

Nulls of role and text are one space each. A null ``conv_id`` is a conversation like others. Repeated rows are duplicates,
an empty table gives no rows, and columns other than ``conv_id``, ``turn``, ``role`` and ``text`` are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiercurve.llm.common import fields

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SYSTEM, USER, ASSISTANT, OTHER = range(4)
CLEAN, CUT, DOOMED = range(3)
WHITE = " \t\n\x0b\x0c\r"
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_NONE = 1 << 28
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_ROWS_OUT = 4096


def _greedy(kinds: list[int]) -> int:
    """What repairing clean rows costs if wrong roles are all changed, or their rows all deleted, the less of both."""
    costs = []
    for price in (REROLE, DELETE):
        rest = kinds[1:] if kinds[:1] == [SYSTEM] else kinds
        need, cost, pairs = USER, 0, False
        for kind in rest:
            if kind != need:
                cost += price
            if kind == need or price == REROLE:
                need = USER + ASSISTANT - need
                pairs = pairs or need == USER
        cost += DELETE * (need == ASSISTANT) + DELETE * (len(rest) < len(kinds) and not pairs)
        costs.append(cost)
    return min(costs)


class _Table:
    """Costs from a row to the end by the length left to align, in a band around the clean rows left.

    ``f`` is for an alternating target, ``g`` for one that still lacks its system turn. The length left at place t
    of row i is ``base[i] + t``.
    """

    def __init__(self, codes: np.ndarray):
        self.kinds, self.faults = (codes & 3).tolist(), (codes >> 2).tolist()
        n = len(codes)
        clean = (codes >> 2) == CLEAN
        left = np.append(np.cumsum(clean[::-1])[::-1], 0)
        spare = _greedy([k for k, c in zip(self.kinds, clean.tolist(), strict=True) if c])
        below, above = spare // DELETE + 1, spare // (TRUNCATED - DELETE) + 1
        self.base = (left - below).tolist()
        self.places = np.arange(below + above + 1)
        self.insert = INSERT * self.places
        length = self.base[n] + self.places
        self.last = (np.where(length >= 0, INSERT * length, _NONE), np.full(len(length), _NONE))
        right = np.where(self.places % 2 == 0, 0, REROLE)
        self.costs = {(USER, 0): right, (USER, 1): REROLE - right, (ASSISTANT, 0): REROLE - right, (ASSISTANT, 1): right}
        self.block = max(64, int(n**0.5))
        self.saved = {n: self.last}
        state = self.last
        for i in range(n - 1, -1, -1):
            state = self._before(i, state)
            if i % self.block == 0:
                self.saved[i] = state

    def _before(self, i: int, state: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The costs at row i from those after it."""
        f, g = state
        kind, fault = self.kinds[i], self.faults[i]
        gone, matched, waiting = f, f, g
        if fault == CLEAN:
            gone, waiting = np.append(f[1:], _NONE), np.append(g[1:], _NONE)
        else:
            matched = np.append(_NONE, f[:-1])
        own, lacking = gone + DELETE, waiting + DELETE
        if fault != DOOMED:
            kept = TRUNCATED if fault == CUT else 0
            own = np.minimum(own, matched + (self.costs.get((kind, self.base[i] % 2), REROLE) + kept))
            if kind == SYSTEM:
                lacking = np.minimum(lacking, gone + kept)
        own = np.minimum.accumulate(own - self.insert) + self.insert
        return np.minimum(own, _NONE), np.minimum(lacking, _NONE)

    def _block(self, first: int, end: int) -> list[tuple[list[int], list[int]]]:
        """The costs of rows ``first`` to ``end``, both included."""
        rows = [self.saved[end]]
        for i in range(end - 1, first - 1, -1):
            rows.append(self._before(i, rows[-1]))
        return [(f.tolist(), g.tolist()) for f, g in reversed(rows)]

    def cheapest(self) -> tuple[int, str]:
        n = len(self.kinds)
        f, g = (x.tolist() for x in self.saved.get(0, self.last))
        ways = [(cost, r, False) for r, cost in enumerate(f, self.base[0]) if r >= 0 and r % 2 == 0]
        ways += [(cost, r, True) for r, cost in enumerate(g, self.base[0]) if r >= 2 and r % 2 == 0]
        least = min(cost for cost, _, _ in ways)
        traces = [(r, lacks, []) for cost, r, lacks in ways if cost == least]
        for first in range(0, n, self.block):
            end = min(first + self.block, n)
            rows = self._block(first, end)
            traces = [self._trace(rows, first, end, *trace) for trace in traces]
        return least, min("".join(letters) + "I" * r for r, _, letters in traces)

    def _trace(self, rows: list[tuple[list[int], list[int]]], first: int, end: int, r: int, lacks: bool, letters: list[str]) -> tuple[int, bool, list[str]]:
        """Follows the least edits from row ``first`` to ``end``; ``r`` is the length left."""

        def at(i: int, r: int, which: int = 0) -> int:
            t = r - self.base[i]
            return rows[i - first][which][t] if 0 <= t < len(self.places) else _NONE

        i = first
        while i < end:
            cost = at(i, r, int(lacks))
            if at(i + 1, r, int(lacks)) + DELETE == cost:
                letters.append("D")
                i += 1
            elif lacks:
                letters.append("K")
                lacks, i = False, i + 1
            elif r and at(i, r - 1) + INSERT == cost:
                letters.append("I")
                r -= 1
            else:
                letters.append("K" if self.kinds[i] == (ASSISTANT if r % 2 else USER) else "R")
                r, i = r - 1, i + 1
        return r, lacks, letters


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and audit of rows given as ``kind + 4 * fault``."""
    return _short(codes) if len(codes) <= 64 else _Table(np.frombuffer(codes, np.uint8).astype(np.int64)).cheapest()


@lru_cache(maxsize=1 << 16)
def _short(codes: bytes) -> tuple[int, str]:
    return _Table(np.frombuffer(codes, np.uint8).astype(np.int64)).cheapest()


def _summary(codes: list[int], turns: list[int], faults: list[int]) -> tuple:
    """The counts of ``SUMMARY``, the cost and the audit of one conversation."""
    kinds = [c & 3 for c in codes]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(pair not in _LEGAL for pair in zip(kinds, kinds[1:], strict=False))
    return (gaps, *(faults.count(k) for k in range(3)), illegal, *cheapest(bytes(codes)))


def _flat(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _prepared(rows: DataFrame, present: Column) -> DataFrame:
    """Rows with nulls as one space, and what the first pass needs of them."""
    spaced = rows.select(
        "conv_id", "turn", present.alias("present"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    ended = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(ended == "", DOOMED).when(F.right(ended, F.lit(1)).isin(".", "!", "?"), CLEAN).otherwise(CUT)
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    return spaced.select("*", (kind + 4 * fault).cast("int").alias("code"), digest.alias("digest"))


def _audits(prepared: DataFrame) -> DataFrame:
    """One row for each conversation: ``conv_id`` and ``SUMMARY``."""
    kind = prepared.schema["conv_id"]
    schema = fields([kind], SUMMARY)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known = None, False
        codes, turns, faults, seen, out = [], [], [], set(), []
        shape = None
        for batch in batches:
            shape = shape or pa.schema([batch.schema.field("conv_id"), *_SUMMARY_FIELDS])
            for conv, turn, present, code, digest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "present", "code", "digest")), strict=True):
                if not known or conv != current:
                    if known:
                        out.append((current, *_summary(codes, turns, faults)))
                    current, known = conv, True
                    codes, turns, faults, seen = [], [], [], set()
                    if len(out) >= _ROWS_OUT:
                        yield _flat(shape, out)
                        out = []
                if not present:
                    continue
                again = digest in seen
                seen.add(digest)
                if code >> 2 == DOOMED:
                    faults.append(0)
                elif again:
                    faults.append(1)
                    code = (code & 3) + 4 * DOOMED
                elif code >> 2 == CUT:
                    faults.append(2)
                codes.append(code)
                if turn is not None:
                    turns.append(turn)
        if known:
            out.append((current, *_summary(codes, turns, faults)))
        if out:
            yield _flat(shape, out)

    narrow = prepared.select("conv_id", "turn", "present", "code", "digest")
    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest").mapInArrow(read, schema)


_SUMMARY_FIELDS = [pa.field(n, pa.string() if n == "audit" else pa.int64()) for n in (x.split()[0] for x in SUMMARY.split(", "))]


class _Applied:
    """The repaired turns of one conversation as its rows come by, in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.need = audit, 0, "user"

    def _next(self) -> str:
        role, self.need = self.need, "assistant" if self.need == "user" else "user"
        return role

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._next(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """``(edit, role, text)`` of the turns inserted before a row and of the row, unless it is deleted."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            if role[:1] != "s":
                self._next()
            yield "K", role, text
        elif edit == "R":
            yield "R", self._next(), text


def _applied(prepared: DataFrame) -> DataFrame:
    """Each conversation's summary, then its rows in order: what the second pass reads."""
    audits = _audits(prepared)
    summary = F.struct(*(f.name for f in _SUMMARY_FIELDS))
    heads = audits.select("conv_id", summary.alias("summary"))
    rows = prepared.where("present").select("conv_id", "turn", "digest", "role", "text")
    both = rows.unionByName(heads, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("summary").isNull(), "turn", "digest").select("conv_id", "role", "text", "summary")


def repaired(rows: DataFrame) -> DataFrame:
    """``(conv_id, position, edit, role, text)``: the turns of the repaired conversations, from position 0 on."""
    schema = fields([rows.schema["conv_id"]], "position long, edit string, role string, text string")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, position, shape = None, _Applied(""), 0, None
        for batch in batches:
            shape = shape or pa.schema([batch.schema.field("conv_id"), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
            out = []
            for conv, role, text, summary in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = state.inserted() if summary else state.row(role, text)
                for turn in turns:
                    out.append((current, position, *turn))
                    position += 1
                if summary:
                    current, state, position = conv, _Applied(summary["audit"]), 0
            if out:
                yield _flat(shape, out)
        rest = [(current, position + k, *turn) for k, turn in enumerate(state.inserted())]
        if rest:
            yield _flat(shape, rest)

    return _applied(_prepared(rows, F.lit(True))).mapInArrow(apply, schema)


def audited(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row for each conversation: ``conv_id``, ``SUMMARY`` and ``repaired_sha256``.

    The digest is that of the repaired turns as ``role:text``, joined by line ends (UTF-8). Rows that are not ``present``
    only name their conversation; one without other rows has zeros, an empty audit and the digest of nothing.
    """
    schema = fields([rows.schema["conv_id"]], f"{SUMMARY}, repaired_sha256 string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, state, hashed, glue, shape = None, _Applied(""), hashlib.sha256(), b"", None
        for batch in batches:
            shape = shape or pa.schema([batch.schema.field("conv_id"), *_SUMMARY_FIELDS, ("repaired_sha256", pa.string())])
            out = []
            for conv, role, text, summary in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for _, who, said in state.inserted() if summary else state.row(role, text):
                    hashed.update(glue + f"{who}:{said}".encode())
                    glue = b"\n"
                if summary:
                    if head is not None:
                        out.append((*head, hashed.hexdigest()))
                    head = (conv, *(summary[f.name] for f in _SUMMARY_FIELDS))
                    state, hashed, glue = _Applied(summary["audit"]), hashlib.sha256(), b""
            if out:
                yield _flat(shape, out)
        if head is not None:
            for _, who, said in state.inserted():
                hashed.update(glue + f"{who}:{said}".encode())
                glue = b"\n"
            yield _flat(shape, [(*head, hashed.hexdigest())])

    return _applied(_prepared(rows, F.lit(True) if present is None else present)).mapInArrow(digest, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped (``present`` is false), emptied, unpunctuated, repeated or given to the user, by crc32 of their place."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    how = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1]).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(how == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (how != 0).alias("present"), copies).drop("copy")


def query(conversations: DataFrame) -> DataFrame:
    return audited(damaged(conversations), F.col("present"))
