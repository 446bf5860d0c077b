"""Secret scans with a trigram index, by DataFrame functions only.

For each rule a Boolean query of trigrams is derived from its regular expression: strings of three or more
letters that every match must contain, as alternatives of sets. The index is a table of postings
``(trigram, document)`` of the trigrams that occur in any query; intersecting the postings of a document
gives the rules for which it is a candidate, and only those expressions run over its text. A rule without a
mandatory trigram (long runs of hex digits) runs over every text. Postings are grouped by document, never by
trigram, so a trigram in most documents makes no group large.

Spans are places in code points, end exclusive, leftmost and without overlap within a rule; overlapping spans of
different rules all stay. The span of a PEM private key holds all of it, not its BEGIN line alone. A null text is empty
and has no span. Rows that repeat ``doc_id`` and text are alike, and an empty table gives no rows. Work is in proportion to
text and spans, however long the text.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``group`` is the part whose length must be ``least`` or more; shorter matches are dropped."""

    name: str
    pattern: str
    group: int
    least: int


# A private key from its BEGIN line through its END line, whatever is between; without an END line of its own through the
# header and base64 lines that follow (or runs of base64 in the same line, where line ends became blanks). Line ends
# may be written as \n. Repeated groups are possessive: Java walks those without recursion, however long the text.
_BEGIN = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
_TO_END = r"(?:[^-]++|-(?!----(?:BEGIN|END)\x20))*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
_BREAK = r"""(?:[\x20\t"',]*+(?:[\r\n]|\\r|\\n)[\x20\t>#|"']*+)++"""
_LINES = (
    r"(?:[\x20\t]++[A-Za-z0-9+/=]{40,}+)*+(?:(?<=[A-Za-z0-9+/=])[\x20\t]++[A-Za-z0-9+/=]++)?+"
    + "(?:" + _BREAK + r"(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+"
    + "(?:" + _BREAK + r"""[A-Za-z0-9+/=]++(?=[\x20\t"',]*+(?![^\r\n\\])))*+"""
)

# The rules in the order in which spans with equal starts are listed. The first three are the base ones.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A run that is too short has no long enough part, so the least length can stand in the expression.
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", _BEGIN + "(?:" + _TO_END + "|" + _LINES + ")", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
)
MOST_STRINGS, MOST_CHARS = 64, 8
RUN, PIECE = 64, 512


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """What every match contains: for each entry, at least one of its sets of trigrams (in lower case)."""
    found: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> set[str]:
        """Notes what ``strings`` demand and starts anew."""
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() not in sets:
            found.append(sorted((x for x in sets if not any(y < x for y in sets)), key=sorted))
        return {""}

    def exact(items) -> set[str] | None:
        """All strings that ``items`` can match, if few."""
        strings = {""}
        for kind, value in items:
            some = one(kind, value)
            if some is None or len(some) * len(strings) > MOST_STRINGS:
                return None
            strings = {a + b for a, b in product(strings, some)}
        return strings

    def one(kind, value) -> set[str] | None:
        if kind is kinds.LITERAL:
            return {chr(value).lower()}
        if kind is kinds.IN and all(k in (kinds.LITERAL, kinds.RANGE) for k, _ in value):
            chars = {chr(c).lower() for k, v in value for c in ([v] if k is kinds.LITERAL else range(v[0], v[1] + 1))}
            return chars if len(chars) <= MOST_CHARS else None
        if kind is kinds.SUBPATTERN:
            return exact(value[3])
        if kind is kinds.BRANCH:
            sets = [exact(x) for x in value[1]]
            return None if None in sets else set().union(*sets)
        if kind is kinds.MAX_REPEAT and value[1] <= 1:
            some = exact(value[2])
            return None if some is None else some | ({""} if value[0] == 0 else set())
        return None

    strings = {""}
    for kind, value in parser.parse(pattern):
        some = one(kind, value)
        if some is None or len(some) * len(strings) > MOST_STRINGS:
            strings = close(strings)
        if some is not None:
            strings = {a + b for a, b in product(strings, some)}
    close(strings)
    return found


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: ``(doc_id, digest, trigram)`` for each of ``trigrams`` that a text holds in any letter case."""
    held = [F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams]
    return docs.select("doc_id", "digest", F.lower("text").alias("low")).select("doc_id", "digest", F.explode(F.array_compact(F.array(*held))).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...], trigrams: list[str]) -> DataFrame:
    """``(doc_id, digest, rules)``: the names of the rules whose queries the postings of a document fulfil."""
    bit = {t: 1 << i for i, t in enumerate(trigrams)}
    number = F.element_at(F.create_map(*(F.lit(x) for t in trigrams for x in (t, bit[t]))), F.col("trigram"))
    held = index.groupBy("doc_id", "digest").agg(F.bit_or(number).alias("held"))
    names = []
    for rule in rules:
        demands = trigram_query(rule.pattern)
        if not demands:
            continue
        fulfilled = F.lit(True)
        for sets in demands:
            either = F.lit(False)
            for some in sets:
                mask = F.lit(sum(bit[t] for t in some)).cast("long")
                either = either | (F.col("held").bitwiseAND(mask) == mask)
            fulfilled = fulfilled & either
        names.append(F.when(fulfilled, F.lit(rule.name)))
    return held.select("doc_id", "digest", F.array_compact(F.array(*names)).alias("rules")).where(F.size("rules") > 0)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(numbers: Column, merge: Callable[[Column, Column], Column], start: Column, depth: int = 3) -> Column:
    """``start`` merged with the first, the first two, the first three ... of ``numbers``.

    Appending copies an array, so only ``RUN`` numbers are appended one by one; runs are merged by their totals, up to
    ``depth`` times. ``numbers`` is named several times: a column or a bound value.
    """
    none = F.array().cast("array<int>")
    if depth == 0:
        state = F.struct(start.alias("at"), none.alias("out"))

        def step(state: Column, x: Column) -> Column:
            at = merge(state["at"], x)
            return F.struct(at.alias("at"), F.array_append(state["out"], at).alias("out"))

        return F.aggregate(numbers, state, step)["out"]

    def joined(runs: Column) -> Column:
        totals = F.transform(runs, lambda run: F.reduce(run, F.lit(0), merge))
        upto = _let(totals, lambda t: _running(t, merge, start, depth - 1))
        each = lambda ends: F.transform(runs, lambda run, k: _running(run, merge, F.when(k == 0, start).otherwise(F.get(ends, k - 1)), 0))
        return F.flatten(_let(upto, each))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / RUN).cast("int")), lambda k: F.slice(numbers, k * RUN + 1, RUN))
    return F.when(F.size(numbers) > 0, _let(runs, joined)).otherwise(none)


def spans_of(rule: Rule, order: int) -> Column:
    """The spans of one rule in ``text``: an array of ``(start, kind order, kind, end)``."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("match"), value.alias("value"))
    met = F.transform(
        F.filter(parts, lambda x: x["match"].isNotNull()),
        lambda x: F.struct((F.length(x["gap"]) + F.length(x["match"])).alias("step"), F.length(x["match"]).alias("long"), F.length(x["value"]).alias("value")),
    )

    def placed(met: Column, ends: Column) -> Column:
        spans = F.transform(
            met,
            lambda x, i: F.struct(
                x["value"].alias("value"),
                F.struct((F.get(ends, i) - x["long"]).alias("start"), F.lit(order).alias("kind"), F.lit(rule.name).alias("name"), F.get(ends, i).alias("end")).alias("span"),
            ),
        )
        return F.transform(F.filter(spans, lambda x: x["value"] >= rule.least), lambda x: x["span"])

    def spans(met: Column) -> Column:
        ends = _let(F.transform(met, lambda x: x["step"]), lambda steps: _running(steps, lambda a, b: a + b, F.lit(0)))
        return _let(ends, lambda e: placed(met, e))

    return _let(met, spans)


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` and ``secret_spans``: all spans as ``(start, kind, name, end)`` by start, then rule. A null text becomes empty."""
    trigrams = sorted({t for r in rules for sets in trigram_query(r.pattern) for s in sets for t in s})
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    digest = F.xxhash64("doc_id", "text")
    index = postings(rows.select("doc_id", "text", digest.alias("digest")), trigrams)
    chosen = candidates(index, rules, trigrams).withColumnsRenamed({"doc_id": "_doc_id", "digest": "_digest", "rules": "_rules"})
    rows = rows.withColumn("_own", digest)
    joined = rows.join(chosen, (rows["_own"] == chosen["_digest"]) & rows["doc_id"].eqNullSafe(chosen["_doc_id"]), "left")
    none = F.array().cast("array<struct<start:int,kind:int,name:string,end:int>>")
    spans = []
    for order, rule in enumerate(rules):
        asked = F.rlike("text", F.lit(rule.pattern))
        if trigram_query(rule.pattern):
            asked = F.coalesce(F.array_contains("_rules", rule.name), F.lit(False)) & asked
        spans.append(F.when(asked, spans_of(rule, order)).otherwise(none))
    return joined.withColumn("secret_spans", F.array_sort(F.concat(*spans))).drop("_own", "_doc_id", "_digest", "_rules")


def redacted(found: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``found`` with every span of its text, overlapping ones together, replaced by ``mark``.

    What stays is cut from pieces of ``PIECE`` characters, since a place in a text is found by walking it.
    """
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(pieces: Column, a: Column, b: Column) -> Column:
        def part(k: Column) -> Column:
            first = F.greatest(a, k * PIECE)
            return F.substring(F.get(pieces, k), first - k * PIECE + 1, F.least(b, (k + 1) * PIECE) - first)

        number = lambda x: F.floor(x / PIECE).cast("int")
        return F.when(a < b, F.array_join(F.transform(F.sequence(number(a), number(b - 1)), part), "")).otherwise("")

    def rebuilt(pieces: Column, tops: Column) -> Column:
        def kept(span: Column, i: Column) -> Column:
            before = F.when(i == 0, 0).otherwise(F.get(tops, i - 1))
            return F.when(span["start"] >= before, F.concat(between(pieces, before, span["start"]), F.lit(mark))).otherwise("")

        last = F.get(tops, F.size(tops) - 1)
        return F.concat(F.array_join(F.transform("secret_spans", kept), ""), between(pieces, last, F.length("text")))

    tops = _let(F.transform("secret_spans", lambda s: s["end"]), lambda ends: _running(ends, lambda a, b: F.greatest(a, b), F.lit(0)))
    out = _let(pieces, lambda p: _let(tops, lambda t: rebuilt(p, t)))
    return found.withColumn("text", F.when(F.size("secret_spans") > 0, out).otherwise(F.col("text")))


def query(docs: DataFrame) -> DataFrame:
    found = secrets(docs.select("doc_id", "text"))
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    listed = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(spans).alias("spans"),
    )
