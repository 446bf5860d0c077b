"""Document fingerprints that add up: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph is a line; within a line, a sentence. Each is hashed to a vector of ``LANES`` bits in ``LONGS`` 64-bit
numbers (two lanes of 32 bits in each) and ``SUMS`` further 64-bit numbers; the fingerprint is the sum of
the vectors of all paragraphs, each number modulo 2**64. So it does not depend on the order of paragraphs,
and ``insert`` and ``delete`` change it by a paragraph's vector without the rest of the text. The full-width sums
tell multisets apart; the lanes count, bit by bit, how often a bit is set, and the angle between two documents'
lane vectors (centred by their numbers of paragraphs) tells how alike the multisets are.

Only DataFrame functions are used. Fingerprints are numbers in hex: paragraphs, sums, lanes. A null text is an empty
one; it and every text without a paragraph have the fingerprint of nothing. Two of these are alike (1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiercurve.llm.common import written

LANES, SUMS = 48, 2
LONGS = LANES // 2
BREAKS = r"[\n\r]+|(?<=[.!?] )"
_BITS = (1 << 32) | 1


def _vector(paragraph_hash: Column) -> list[Column]:
    """What a paragraph adds to each number, from its 64-bit hash."""
    adds = [F.xxhash64(paragraph_hash, F.lit(k)) for k in range(SUMS)]
    return adds + [F.shiftright(paragraph_hash, k).bitwiseAND(F.lit(_BITS)) for k in range(LONGS)]


def hashes(text: Column) -> Column:
    """The hashes of the paragraphs of a text, in its order."""
    parts = F.transform(F.split(text, BREAKS, -1), lambda p: F.btrim(p))
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.xxhash64(p))


def vector(paragraphs: Column) -> Column:
    """The fingerprint of some paragraph hashes as numbers: how many, the sums, the lanes two by two."""
    zero = F.lit(0).cast("long")

    def total(k: int) -> Column:
        return F.aggregate(paragraphs, zero, lambda s, h: _add(s, _vector(h)[k]) if k < SUMS else s + _vector(h)[k])

    return F.array(F.size(paragraphs).cast("long"), *(total(k) for k in range(SUMS + LONGS)))


def _add(a: Column, b: Column) -> Column:
    """Sum modulo 2**64 of two longs, also where Spark checks for overflow."""
    half = F.lit((1 << 32) - 1)
    low = a.bitwiseAND(half) + b.bitwiseAND(half)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(half))


def insert(numbers: Column, paragraph: Column) -> Column:
    """The vector after a paragraph is added."""
    adds = F.array(F.lit(1).cast("long"), *_vector(F.xxhash64(F.btrim(paragraph))))
    return F.zip_with(numbers, adds, _add)


def delete(numbers: Column, paragraph: Column) -> Column:
    """The vector after a paragraph is taken away."""
    adds = F.array(F.lit(1).cast("long"), *_vector(F.xxhash64(F.btrim(paragraph))))
    return F.zip_with(numbers, adds, lambda a, b: _add(a, _add(F.bitwise_not(b), F.lit(1).cast("long"))))


def written_out(numbers: Column) -> Column:
    """A vector as text."""
    return F.array_join(F.transform(numbers, lambda x: F.lower(F.hex(x))), "-")


def likeness(a: Column, b: Column) -> Column:
    """How alike two vectors' multisets are: 1 if equal, else the cosine of the centred lanes, 0 at least."""

    def lanes(v: Column) -> Column:
        low = F.transform(F.slice(v, SUMS + 2, LONGS), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)))
        high = F.transform(F.slice(v, SUMS + 2, LONGS), lambda x: F.shiftrightunsigned(x, 32))
        return F.transform(F.concat(low, high), lambda x: x.cast("double") - v[0] / F.lit(2.0))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, y: s + y)

    la, lb = lanes(a), lanes(b)
    product = total(F.zip_with(la, lb, lambda x, y: x * y))
    size = F.sqrt(total(F.transform(la, lambda x: x * x)) * total(F.transform(lb, lambda x: x * x)))
    return F.when(a == b, F.lit(1.0)).when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), product / size))).otherwise(F.lit(0.0))


def with_vector(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` and the vector of a text column. The hashes are a column first, or each sum would split the text again."""
    return df.withColumn("_hashes", hashes(F.col(text))).withColumn(name, vector(F.col("_hashes"))).drop("_hashes")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, numbers, fingerprint)`` of every row; a null text becomes empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_vector(rows, "text", "numbers").withColumn("fingerprint", written_out(F.col("numbers")))


def followers(keys: DataFrame, descending: bool = True) -> DataFrame:
    """Each distinct ``(doc_id, digest)`` with the one after it, ``(next_id, next_digest)``; after the last comes the first.

    The order is by doc_id (null last when descending), then digest. Keys are dealt by ranges; a window covers
    a range, and one more has a row for each range. They are a written table, so that the ranges hold still.
    """
    first, second = ("doc_id", "digest")
    by = [F.desc_nulls_last(first), F.col(second)] if descending else [F.asc_nulls_first(first), F.col(second)]
    ranged = written(keys.distinct().repartitionByRange(*by).withColumn("range", F.spark_partition_id()))
    within = Window.partitionBy("range").orderBy(*by)
    pair = F.struct("doc_id", "digest")
    numbered = ranged.withColumn("after", F.lead(pair).over(within)).withColumn("place", F.row_number().over(within))
    heads = numbered.where(F.col("place") == 1).select("range", pair.alias("head"))
    ring = Window.orderBy("range")  # a row for each range
    everything = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("range", F.coalesce(F.lead("head").over(ring), F.first("head").over(everything)).alias("next_head"))
    after = F.coalesce("after", "next_head")
    return numbered.join(F.broadcast(heads), "range").select("doc_id", "digest", after["doc_id"].alias("next_id"), after["digest"].alias("next_digest"))


def edited(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, numbers, next_numbers, edited)``: vectors of each row and of the document after it, and the edited text.

    The edit puts the first code points of the next document, in descending order of ``doc_id``, in place of the
    last half (rounded down). Rows that repeat ``doc_id`` and text are one document in that order.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Both joins below read the same columns of it in the same partitions, so that texts are shuffled once for the two.
    own = with_vector(rows, "text", "numbers").withColumn("digest", F.xxhash64("doc_id", "text"))
    keys = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("digest"), F.length("text").alias("n_chars"))
    order = followers(keys.select("doc_id", "digest"))
    halves = keys.distinct().select("digest", F.col("doc_id").alias("of_id"), F.expr("n_chars div 2").cast("int").alias("half"))
    wanted = order.join(halves, (order["digest"] == halves["digest"]) & order["doc_id"].eqNullSafe(halves["of_id"])).select(
        "next_id", "next_digest", "of_id", halves["digest"].alias("of_digest"), "half"
    )
    handed = wanted.join(own, (wanted["next_digest"] == own["digest"]) & wanted["next_id"].eqNullSafe(own["doc_id"])).select(
        "of_id", "of_digest", F.substring(F.col("text"), F.lit(1), F.col("half")).alias("instead"), F.col("numbers").alias("next_numbers")
    ).dropDuplicates(["of_id", "of_digest"])  # one row for each, but where the next document is repeated
    both = own.join(handed, (own["digest"] == handed["of_digest"]) & own["doc_id"].eqNullSafe(handed["of_id"]))
    length = F.length("text")
    text = F.concat(F.substring(F.col("text"), F.lit(1), (length - F.expr("length(text) div 2")).cast("int")), F.col("instead"))
    return both.select("doc_id", length.cast("long").alias("n_chars"), "numbers", "next_numbers", text.alias("edited"))


def query(docs: DataFrame) -> DataFrame:
    numbers, after, following = F.col("numbers"), F.col("edited_numbers"), F.col("next_numbers")
    return with_vector(edited(docs), "edited", "edited_numbers").select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written_out(numbers).alias("fingerprint"),
        written_out(after).alias("edited_fingerprint"), likeness(numbers, after).alias("near_edited"), likeness(numbers, following).alias("near_next"),
    )
