"""Near duplicates by BagMinHash: weighted-Jaccard signatures of the multisets of five-word shingles.

Words are parted by ASCII white space, otherwise unchanged; a shorter text with words is one shingle. Two texts
are linked if the sum of the lesser counts of their shingles is at least 0.8 of the sum of the greater; a class is
what links connect. Texts without words are linked to nothing.

* *Signatures.* The weight axis (counts) is cut into the blocks [0, 1), [1, 2), [2, 4), [4, 8), ... Each shingle and block
  has a Poisson process whose rate is the block's width; every point has a time, a slot of the signature and a weight
  drawn within the block, and counts if the weight is below the shingle's. A slot keeps the earliest point. So two texts agree in a slot with probability equal to their weighted Jaccard
  similarity, and after the first points only processes that may still beat a slot's time go on.
* *Bands.* Texts that agree in all ``ROWS`` slots of one of ``BANDS`` bands are candidates: at similarity 0.8, all but
  7 pairs in a million.
* *Verification.* Candidates are verified on the multisets themselves. Equal multisets are one text first. Then every
  text is compared with the least text of its bucket, so a large group of copies costs one comparison for each and
  no pairs. Texts apart from the largest class in their bucket then meet all of the bucket: sketches and multisets go
  there, once for each text, and are compared in the task, with ``LEADERS`` texts of the largest class first, and what these
  leave apart with all others, the most alike first. So no candidate link between different classes is left unseen, but no
  pair leaves the task unless it is a link that connects what the task has not connected: fewer links than texts. A pair whose
  one-byte slots agree in fewer than ``SKETCH`` of all is passed over (at 0.8, five pairs in a billion).

Repeated rows and equal texts are in one class. The class is named by the least ``doc_id`` in it; a null ``doc_id``
comes last and names a class only if all its ids are null, in which case the class is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiercurve.llm.common import SPACED, Words, fields, grams, mix, text_chunks, trimmed, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
SLOTS = BANDS * ROWS
SKETCH = 0.6
LEADERS, TRIED = 4, 8
BLOCK_BYTES, TASK_BYTES = 4 << 20, 24 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, shingle, count)`` of the distinct shingles of each document, by document and shingle."""
    prefix = grams(words.hashes())
    starts, counts = words.gram_starts(n), words.counts()
    short = np.flatnonzero((counts > 0) & (counts < n))
    found = np.concatenate([prefix(starts, starts + n), prefix(words.first[short], words.first[short + 1])])
    documents = np.concatenate([words.documents()[starts], short])
    order = np.lexsort((found, documents))
    found, documents = found[order], documents[order]
    new = np.flatnonzero((np.diff(documents, prepend=-1) != 0) | np.append(True, found[1:] != found[:-1])[: len(found)])
    return documents[new], found[new], np.diff(np.append(new, len(found)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from the upper bits of hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)


def signatures(documents: np.ndarray, found: np.ndarray, counts: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """The signatures (``n`` rows of 32-bit marks) of weighted sets; a row without elements is zero."""
    times = np.full(n * slots, np.inf)
    marks = np.zeros(n * slots, np.uint64)
    # One process for each shingle and block of weights: block 0 is [0, 1), block j is [2^(j-1), 2^j).
    blocks = np.ceil(np.log2(counts)).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(found)), blocks)
    block = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block == 0, 0.0, np.exp2(block - 1.0))
    width = np.maximum(low, 1.0)
    key = mix(found[owner] + block.astype(np.uint64) * _GOLDEN)
    document, weight, time = documents[owner], counts[owner], np.zeros(len(owner))
    while len(key):
        key = mix(key + _GOLDEN)
        time = time - np.log(_uniform(key)) / width
        point = mix(key ^ np.uint64(0xA0761D6478BD642F))
        slot = document * slots + (point % np.uint64(slots)).astype(np.int64)
        inside = low + _uniform(mix(point)) * width <= weight
        better = np.flatnonzero(inside & (time < times[slot]))
        if len(better):
            better = better[np.lexsort((-time[better], slot[better]))]  # of several, the earliest is written last
            times[slot[better]] = time[better]
            marks[slot[better]] = point[better]
        limit = times.reshape(n, slots).max(1)
        live = time < limit[document]
        key, time, low, width, document, weight = key[live], time[live], low[live], width[live], document[live], weight[live]
    return (mix(marks) >> np.uint64(32)).astype(np.uint32).reshape(n, slots) * (np.isfinite(times).reshape(n, slots))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in text_chunks(batch):
            n = end - first
            documents, found, counts = shingles(Words(data, offsets, SPACED))
            sizes = np.bincount(documents, counts, n).astype(np.int64)
            each = mix(found + mix(counts.astype(np.uint64)))
            sums = np.zeros((n, 2), np.uint64)  # of the whole multiset, 128 bits
            np.add.at(sums[:, 0], documents, each)
            np.add.at(sums[:, 1], documents, mix(each ^ _GOLDEN))
            marks = signatures(documents, found, counts, n)
            bands = grams(marks.ravel().astype(np.uint64))
            starts = np.arange(0, n * SLOTS, ROWS)
            hashed = mix(bands(starts, starts + ROWS) + (np.arange(n * BANDS) % BANDS).astype(np.uint64)).view(np.int64)
            sketch = (marks & 0xFF).astype(np.uint8).tobytes()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(hashed))
            columns = [
                batch.column("doc_id").slice(first, n), batch.column("key").slice(first, n),
                pa.array([f"{a:016x}{b:016x}" if s else None for a, b, s in zip(*sums.T.tolist(), sizes.tolist(), strict=True)], pa.string()),
                pa.array(sizes), lists, pa.array([sketch[i * SLOTS : (i + 1) * SLOTS] for i in range(n)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "content", "size", "bands", "sketch"])


def signed(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, content, size, bands, sketch)``: the text's digest, the multiset's (null without words), its size and signature."""
    schema = fields([docs.schema["doc_id"]], "key string, content string, size long, bands array<bigint>, sketch binary")
    return docs.select("doc_id", "text", F.md5("text").alias("key")).mapInArrow(lambda batches: trimmed(_signed(batches)), schema)


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose multisets overlap enough."""
    for batch in batches:
        a, b = batch.column("text_a"), batch.column("text_b")
        keep = np.zeros(batch.num_rows, bool)
        row = 0
        while row < batch.num_rows:
            end, size = row, 0
            while end < batch.num_rows and (size < 1 << 20 or end == row):
                size += len(a[end].as_buffer()) + len(b[end].as_buffer())
                end += 1
            bags = []
            for side in (a, b):
                whole = pa.RecordBatch.from_arrays([side.slice(row, end - row)], ["text"])
                bags.append([np.concatenate(x) for x in zip(*(_shifted(c) for c in text_chunks(whole)), strict=True)])
            documents = np.concatenate([bags[0][0], bags[1][0]])
            found = np.concatenate([bags[0][1], bags[1][1]])
            counts = np.concatenate([bags[0][2], bags[1][2]])
            order = np.lexsort((found, documents))
            documents, found, counts = documents[order], found[order], counts[order]
            both = (documents[1:] == documents[:-1]) & (found[1:] == found[:-1])
            least = np.bincount(documents[1:][both], np.minimum(counts[1:], counts[:-1])[both], end - row)
            total = np.bincount(documents, counts, end - row) - least
            keep[row:end] = (total > 0) & (least >= SIMILARITY * total - 1e-9)
            row = end
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _shifted(chunk: tuple[int, int, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, _, data, offsets = chunk
    documents, found, counts = shingles(Words(data, offsets, SPACED))
    return documents + first, found, counts


def _likely(sketch_a: np.ndarray, sketch_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether sketches and sizes allow enough overlap."""
    agree = (sketch_a == sketch_b).mean(-1) >= SKETCH
    return agree & (np.minimum(size_a, size_b) >= SIMILARITY * np.maximum(size_a, size_b) - 1e-9)


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SLOTS)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the likely ones of pairs."""
    for batch in batches:
        sizes = [batch.column(c).to_numpy() for c in ("size_a", "size_b")]
        keep = _likely(*(_sketches(batch.column(c)) for c in ("sketch_a", "sketch_b")), *sizes)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _listed(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The likely ones of listed pairs ``(a, b)`` of ids."""
    pairs = pairs.distinct()
    for side in ("a", "b"):
        own = sketches.select(F.col("id").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        pairs = pairs.join(own, side)
    return pairs.mapInArrow(_alike, "a long, b long")


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Multisets as sorted sets of 64-bit numbers: a shingle's k-th occurrence is an element of its own."""
    for batch in batches:
        for first, end, data, offsets in text_chunks(batch):
            documents, found, counts = shingles(Words(data, offsets, SPACED))
            owner = np.repeat(np.arange(len(found)), counts)
            again = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            elements = found[owner] ^ mix(again.astype(np.uint64) * _GOLDEN)
            of = documents[owner]
            order = np.lexsort((elements, of))
            raw, cuts = elements[order].astype("<u8").tobytes(), np.searchsorted(of, np.arange(end - first + 1)) * 8
            bags = [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, end - first), pa.array(bags, pa.binary())], ["id", "bag"])


class _Cell:
    """The texts of one bucket, or of two blocks of it, and which of them are connected as far as is known."""

    def __init__(self, ids: np.ndarray, roots: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, bags: list[np.ndarray]):
        self.ids, self.roots, self.sizes, self.sketches, self.bags = ids, roots, sizes, sketches, bags
        self.part = np.unique(roots, return_inverse=True)[1]

    def links(self, i: int, others: np.ndarray) -> list[tuple[int, int]]:
        """Links of the class of text ``i`` with those of ``others`` it is not yet connected with, one for each part they are in.

        The most alike come first, and once a part is connected, no more of it are compared.
        """
        some = others[self.part[others] != self.part[i]]
        some = some[_likely(self.sketches[i], self.sketches[some], self.sizes[i], self.sizes[some])]
        some = some[np.argsort((self.sketches[some] != self.sketches[i]).sum(1), kind="stable")]
        own, out, tried = self.bags[i], [], TRIED
        while len(some):
            now, some, tried = some[:tried], some[tried:], 2 * tried
            bags = [self.bags[j] for j in now.tolist()]
            lengths = np.array([len(x) for x in bags])
            every = np.concatenate(bags)
            place = np.minimum(np.searchsorted(own, every), len(own) - 1)
            common = np.add.reduceat(own[place] == every, np.cumsum(lengths) - lengths)
            for j in now[common >= SIMILARITY * (len(own) + lengths - common) - 1e-9].tolist():
                if self.part[j] != self.part[i]:
                    out.append((int(self.roots[i]), int(self.roots[j])))
                    self.part[self.part == self.part[j]] = self.part[i]
            some = some[self.part[some] != self.part[i]]
        return out

    def connect(self, own: np.ndarray, apart: np.ndarray, within: bool) -> list[tuple[int, int]]:
        """Links between the texts of two blocks (numbers ``own``), or ``within`` one, at least one of them ``apart`` from the largest class."""
        found: list[tuple[int, int]] = []
        largest = np.flatnonzero(~apart)
        if len(largest):
            leaders = largest[np.argsort(mix(self.ids[largest].astype(np.uint64)), kind="stable")[:LEADERS]]
            for i in np.flatnonzero(apart).tolist():
                found += self.links(i, leaders)
            apart = self.part != self.part[leaders[0]]
        met = ~apart
        later = np.ones(len(own), bool)
        for i in np.flatnonzero(apart).tolist():
            later[i] = False  # met by all others that are apart from now on
            found += self.links(i, np.flatnonzero((later | met) if within else (own != own[i]) & (later | met)))
        return found


def _connected(table: pa.Table) -> pa.Table:
    """Links between classes that connect the texts of a task's cells, fewer than texts."""
    numbers = {n: table[n].to_numpy() for n in ("bucket", "low", "high", "own", "id", "root", "size")}
    apart = table["apart"].to_numpy(zero_copy_only=False).astype(bool)
    sketches = _sketches(table["sketch"])
    bags = [np.frombuffer(b.as_buffer(), "<u8") for chunk in table["bag"].chunks for b in chunk]
    cells = np.stack([numbers[n].astype(np.int64) for n in ("bucket", "low", "high")])
    order = np.lexsort((numbers["id"], *cells))
    new = np.flatnonzero(np.append(True, (np.diff(cells[:, order], axis=1) != 0).any(0))[: len(order)])
    found: set[tuple[int, int]] = set()
    for first, end in zip(new, np.append(new[1:], len(order)), strict=True):
        at = order[first:end]
        cell = _Cell(numbers["id"][at], numbers["root"][at], numbers["size"][at], sketches[at], [bags[k] for k in at.tolist()])
        within = numbers["low"][at[0]] == numbers["high"][at[0]]
        found |= {(max(x), min(x)) for x in cell.connect(numbers["own"][at], apart[at], within)}
    pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _within(placed: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the classes of each text apart from its bucket's largest class and of all in the bucket it has a link to.

    Large buckets are cut into blocks of about ``BLOCK_BYTES``, and each block meets each; small ones share a task.
    """
    bags = texts.join(placed.select("id").distinct(), "id", "left_semi").select("id", "text").mapInArrow(_bagged, "id long, bag binary")
    weighed = placed.join(sketches, "id").withColumn("bytes", 8 * F.col("size") + 256)
    total = weighed.agg(F.sum("bytes")).first()[0] or 0
    counts = weighed.groupBy("bucket").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    full = weighed.join(counts, "bucket").join(bags, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    names = ["bucket", "id", "root", "size", "sketch", "bag", "own"]
    dealt = full.select(*names, (F.col("root") != F.col("head")).alias("apart"), other)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    task = F.pmod(F.xxhash64("bucket", low, high), F.lit(-(-total // TASK_BYTES) or 1)).alias("task")
    cells = dealt.select(*names, "apart", low.alias("low"), high.alias("high"), task)
    return cells.groupBy("task").applyInArrow(_connected, "a long, b long")


def _verified(likely: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct pairs ``(a, b)`` whose multisets overlap by ``SIMILARITY`` or more."""
    likely = written(likely)
    for side in ("a", "b"):
        likely = likely.join(texts.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}")), side)
    return written(likely.mapInArrow(_overlap, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` of every end of ``links`` ``(a, b)``: the least id connected with it.

    Alternating large and small stars: links are rewired towards the least neighbour until they are stars. Links
    are tables in the shared folder; no link reaches the driver.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    while not _stars(edges):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")))  # a row for each link
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        edges = written(small.select("e.a", "e.b").where("a != b").distinct())
    roots = edges.select("b").distinct()
    return written(edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionAll(roots.select(F.col("b").alias("id"), F.col("b").alias("root"))))


def _stars(edges: DataFrame) -> bool:
    """Whether each ``a`` has one ``b`` only, which is no ``a``: then ``b`` is the least id of all that it is connected with."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, root, class_id)`` of every row of ``docs``.

    ``key`` is the md5 of its text, ``root`` a number of the class (null without words), of use only within this result.
    """
    docs = docs.select("doc_id", "text")
    marks = written(signed(docs))
    distinct = marks.where(F.col("content").isNotNull()).groupBy("content").agg(
        F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("key").alias("key")
    )
    distinct = written(distinct.withColumn("id", F.monotonically_increasing_id()))  # ids hold still in the table
    members = distinct.select("id", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = written(members.join(buckets, "bucket"))  # in buckets of two texts or more
    some = distinct.join(shared.select("id").distinct(), "id", "left_semi")
    sketches, keys = some.select("id", "size", "sketch"), some.select("id", "key")
    texts = written(docs.withColumn("key", F.md5("text")).join(keys, "key").groupBy("id").agg(F.first("text").alias("text")))

    pairs = shared.where("id != low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    roots = components(_verified(_listed(pairs, sketches), texts))
    joined = components(_within(_placed(shared, roots), sketches, texts))  # of classes, by their roots

    classes = marks.select("doc_id", "key", "content").join(distinct.select("content", "id"), "content", "left")
    classes = classes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    classes = classes.join(joined.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left")
    classes = classes.withColumn("root", F.coalesce("top", "root"))
    names = classes.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("class_id"))
    name = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return classes.join(names, "root", "left").select("doc_id", "key", "root", name.alias("class_id"))


def _placed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets of more than one class, with the root of each text and of the largest class in its bucket."""
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("many"))
    known = roots.join(sizes, "root")
    placed = shared.join(known, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"), F.coalesce("many", F.lit(1)).alias("many"))
    largest = F.max(F.struct("many", (-F.col("root")).alias("root")))  # of several, that of the least root
    heads = placed.groupBy("bucket").agg(largest.alias("largest"), F.min("root").alias("least"), F.max("root").alias("most"))
    heads = heads.where("least != most").select("bucket", (-F.col("largest.root")).alias("head"))
    return written(placed.join(heads, "bucket").select("bucket", "id", "root", "head"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (``doc_id``, ``text`` and others) that stay: one of each class, and all without words.

    That of the least id stays (null last), of equal ids the one with the least text digest; of rows alike in both, any.
    """
    classes = near_duplicates(docs).where(F.col("root").isNotNull()).groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("times"))
    best = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "times")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("_id"), F.col("best.key").alias("_key"), F.col("best.times").alias("_times"))
    words = F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    keyed = docs.where(words).withColumn("_md5", F.md5("text"))
    kept = keyed.join(best, (keyed["_md5"] == best["_key"]) & keyed["doc_id"].eqNullSafe(best["_id"]))
    once, again = kept.where("_times = 1"), kept.where("_times > 1").dropDuplicates(["_id", "_key"])
    return once.unionAll(again).select(docs.columns).unionAll(docs.where(~words))
