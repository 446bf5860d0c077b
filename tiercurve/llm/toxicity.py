"""Toxicity from subword bags: averaged embeddings of words and their n-grams in a linear softmax, trained jointly.

A word is a run of ASCII letters, digits and bytes above 127, in lower case. Its vector is the mean of
the vectors of itself and its byte n-grams of 3 and 4, word edges included, so a misspelling never
seen shares most of its vector with the words it resembles. A text is cut into even passages of at most
``PASSAGE`` words, and a passage is the mean of its distinct words and ``PADDING`` neutral ones, so that
a few words decide a long text as they decide a short one: a text is as toxic as its most toxic passage.

Vectors and the softmax are trained together in numpy on the driver, on passages that carry their document's label, from
a bounded sample: about ``PER_CLASS`` labelled documents of each class, one row for each id, and of each document at
most ``PASSAGES`` passages, chosen by hash. Passages in a few documents pull their n-grams little
(Adam with a large epsilon), and the model is the mean of the later steps. A fifth of the sampled documents is kept
from a first training; their passages' scores set scale and offset of the log-odds, and the model is trained
again on all. Scoring reads every whole text: as the model is linear, each n-gram adds one number.

Null and empty texts, and texts without words, get the score of an empty bag. Repeated rows are scored
alike. Without labelled rows of both classes, every score is the share of toxic labels (0 without labels). An empty
table gives no rows. A very long text is as many passages as it needs and takes memory in proportion to itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiercurve.llm.common import Words, byte_set, labelled_sample, mix, release, remainder, text_chunks, trimmed, with_column

PER_CLASS, PASSAGES = 2000, 6
CHUNK_BYTES = 1 << 18  # of text at a time; its n-grams take some hundred times as much memory
BUCKETS = 1 << 16
SIZES = (3, 4)
PASSAGE, PADDING = 50, 10
KEPT, ALARM = 5, 1.5  # one in so many sampled documents sets the offset; what a false alarm costs against a miss
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
WORD_BYTES = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def subword_bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(passage, bucket, weight)`` of every n-gram of a passage's distinct words, and each document's first passage.

    A word weighs 1 over the number of distinct words and ``PADDING`` neutral ones. A document has a passage at least.
    """
    data = LOWER[data]
    words = Words(data, offsets, WORD_BYTES)
    hashes, documents, counts = words.hashes(), words.documents(), words.counts()
    passages = np.maximum(-(-counts // PASSAGE), 1)
    firsts = np.concatenate([[0], np.cumsum(passages)])
    length = np.maximum(-(-counts // passages), 1)
    passage = firsts[:-1][documents] + (np.arange(len(hashes)) - words.first[:-1][documents]) // length[documents]
    _, once = np.unique(hashes ^ mix(passage.astype(np.uint64)), return_index=True)
    start, end, hashes, word_documents = words.start[once], words.end[once], hashes[once], passage[once]
    distinct = np.bincount(word_documents, minlength=firsts[-1])
    # Each byte of a word, and a zero on either side of every word.
    lengths = end - start + 2
    begin = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(begin[-1]) - begin[:-1][owner]
    padded = np.zeros(begin[-1] + max(SIZES), np.uint64)
    inner = (place > 0) & (place < lengths[owner] - 1)
    padded[: begin[-1]][inner] = data[(start[owner] + place - 1)[inner]]
    pieces = [np.maximum(lengths - n + 1, 0) for n in SIZES]
    total = sum(pieces) + 1
    weight = (1.0 / (total * (distinct[word_documents] + PADDING))).astype(np.float32)
    documents, buckets, weights = [word_documents], [mix(hashes) & np.uint64(BUCKETS - 1)], [weight]
    code = padded[: begin[-1]] + (padded[1 : begin[-1] + 1] << np.uint64(8))
    for n in SIZES:
        code = code + (padded[n - 1 : begin[-1] + n - 1] << np.uint64(8 * (n - 1)))
        valid = place <= lengths[owner] - n
        of = owner[valid]
        documents.append(word_documents[of])
        buckets.append(mix(code[valid] + np.uint64(n << 56)) & np.uint64(BUCKETS - 1))
        weights.append(weight[of])
    return np.concatenate(documents), np.concatenate(buckets).astype(np.int64), np.concatenate(weights), firsts


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bags of passages, with weights as half floats: four bytes an n-gram; all of a document's for those kept back."""
    for batch in batches:
        for first, end, data, offsets in text_chunks(batch, limit=CHUNK_BYTES):
            owners, buckets, weights, firsts = subword_bags(data, offsets)
            keys, at = np.unique(owners * BUCKETS + buckets, return_inverse=True)
            sums = np.bincount(at, weights, len(keys)).astype(np.float16)
            cuts = np.searchsorted(keys // BUCKETS, np.arange(firsts[-1] + 1))
            ids = (keys % BUCKETS).astype(np.uint16)
            draws = batch.column(batch.schema.get_field_index("draw")).slice(first, end - first).to_numpy()
            labels = batch.column(batch.schema.get_field_index("label")).slice(first, end - first).to_numpy()
            out: list[list] = [[] for _ in range(4)]
            for k in range(end - first):
                some = np.arange(firsts[k], firsts[k + 1])
                order = np.argsort(mix((some - firsts[k] + int(draws[k]) % (1 << 32)).astype(np.uint64)), kind="stable")
                for p in np.sort(some[order[:PASSAGES]]):
                    own = slice(cuts[p], cuts[p + 1])
                    for column, value in zip(out, (labels[k], draws[k], ids[own].tobytes(), sums[own].tobytes()), strict=True):
                        column.append(value)
            types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["label", "draw", "ids", "weights"])


class Bags:
    """All sampled passages: n-grams of one after another, with their weights."""

    def __init__(self, rows: pa.Table):
        order = np.lexsort((rows["ids"].to_pylist(), rows["label"].to_numpy(), rows["draw"].to_numpy()))
        rows = rows.take(pa.array(order))
        self.label, self.document = rows["label"].to_numpy(), rows["draw"].to_numpy()
        sizes = np.array([len(b) for b in rows["ids"].to_pylist()], np.int64) // 2
        self.cuts = np.append(0, np.cumsum(sizes))
        self.ids = np.frombuffer(b"".join(rows["ids"].to_pylist()), np.uint16)
        self.weights = np.frombuffer(b"".join(rows["weights"].to_pylist()), np.float16)

    def __len__(self) -> int:
        return len(self.label)

    def bag(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.cuts[i], self.cuts[i + 1])
        return self.ids[own], self.weights[own].astype(np.float32)


class Batch:
    """Some bags, their entries once by document and once by bucket."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray):
        self.label = label
        sizes = np.array([len(ids) for ids, _ in bags])
        self.filled = np.flatnonzero(sizes)
        self.starts = (np.cumsum(sizes) - sizes)[self.filled]
        self.ids = np.concatenate([ids for ids, _ in bags])
        self.weights = np.concatenate([weights for _, weights in bags])[:, None]
        self.order = np.argsort(self.ids, kind="stable").astype(np.int32)
        self.documents = np.repeat(np.arange(len(bags), dtype=np.int16), sizes)[self.order]
        self.buckets, self.cuts = np.unique(self.ids[self.order], return_index=True)

    def means(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.label), vectors.shape[1]), np.float32)
        if len(self.filled):
            out[self.filled] = np.add.reduceat(vectors[self.ids] * self.weights, self.starts, axis=0)
        return out

    def pull(self, back: np.ndarray) -> np.ndarray:
        """The gradient of each of ``buckets``, from that of each document's mean."""
        return np.add.reduceat(back[self.documents] * self.weights[self.order], self.cuts, axis=0)


def train(
    bags: Bags, some: np.ndarray, width: int = 4, steps: int = 300, batch: int = 256, rate: float = 5.0, epsilon: float = 1e-4
) -> tuple[np.ndarray, float]:
    """What each bucket adds to the log-odds of class 1, and the log-odds of an empty bag, from the passages ``some``.

    Adam on the buckets met; ``epsilon`` damps buckets that few passages pull. The mean of the later steps.
    """
    random = np.random.default_rng(7)
    share = float(np.clip(bags.label[some].mean(), 1e-6, 1 - 1e-6))
    order = random.permutation(some)
    vectors = (random.normal(size=(BUCKETS, width)) * 0.01).astype(np.float32)
    soft = random.normal(size=(width, 2)).astype(np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (vectors, soft, bias)]
    adds, empty, taken = np.zeros(BUCKETS), 0.0, 0
    for step in range(1, steps + 1):
        first = (step - 1) * batch % max(1, len(order))
        chosen = order[first : first + batch]
        own = Batch([bags.bag(i) for i in chosen], bags.label[chosen])
        if not len(own.ids):
            continue
        mean = own.means(vectors)
        logits = mean @ soft + bias
        odds = np.exp(logits - logits.max(1, keepdims=True))
        error = odds / odds.sum(1, keepdims=True)
        error[np.arange(len(error)), own.label] -= 1
        error /= len(error)
        gradients = ((own.buckets, own.pull(error @ soft.T)), (slice(None), mean.T @ error), (slice(None), error.sum(0)))
        speeds = ((rate, epsilon), (0.02, 1e-8), (0.02, 1e-8))
        for x, (at, gradient), (m, v), (speed, least) in zip((vectors, soft, bias), gradients, moments, speeds, strict=True):
            m[at] += 0.1 * (gradient - m[at])
            v[at] += 0.01 * (gradient * gradient - v[at])
            x[at] -= speed * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + least)
        if step > steps // 4 and step % 4 == 0:
            adds += vectors @ (soft[:, 1] - soft[:, 0])
            empty += float(bias[1] - bias[0])
            taken += 1
    return (adds / max(1, taken)).astype(np.float32), empty / max(1, taken)


def calibrated(odds: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and offset of log-odds that fit the labels best (logistic regression by Newton's steps, a little held to 1 and 0)."""
    scale, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(scale * odds + offset, -30, 30)))
        error, slope = weight * (p - label), weight * p * (1 - p)
        gradient = np.array([(error * odds).sum() + 0.01 * (scale - 1), error.sum() + 0.01 * offset])
        cross = (slope * odds).sum()
        hessian = np.array([[(slope * odds * odds).sum() + 0.01, cross], [cross, slope.sum() + 0.01]])
        change = np.linalg.solve(hessian, gradient)
        scale, offset = scale - float(np.clip(change[0], -1, 1)), offset - float(np.clip(change[1], -2, 2))
    return max(scale, 0.05), offset


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int = PER_CLASS) -> tuple[np.ndarray, float, float, float]:
    """Trains on the labelled documents that ``learn`` (a condition on ``doc_id``) admits.

    Returns what a bucket adds, the log-odds of an empty bag, and scale and offset of a document's log-odds. What the
    training took goes back to the system, as the driver's later work needs it.
    """
    try:
        return _fitted(docs, labels, label, learn, per_class)
    finally:
        release()


def _fitted(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> tuple[np.ndarray, float, float, float]:
    sample, counts = labelled_sample(docs, labels, label, learn, per_class)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    once = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    drawn = once.select("text", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("draw"))
    bags = Bags(drawn.mapInArrow(_bags, "label int, draw long, ids binary, weights binary").toArrow())
    kept = bags.document % KEPT == 0
    if len({*bags.label[~kept].tolist()}) < 2:
        return np.zeros(BUCKETS, np.float32), float(np.log(max(share, 1e-9)) - np.log(max(1 - share, 1e-9))), 1.0, 0.0
    adds, empty = train(bags, np.flatnonzero(~kept))
    odds = [float((w * adds[ids]).sum()) + empty for ids, w in map(bags.bag, np.flatnonzero(kept))]
    # Documents of both classes weigh as they do among all labels, not in the sample.
    documents, at = np.unique(bags.document[kept], return_inverse=True)
    most, known = np.full(len(documents), -np.inf), np.zeros(len(documents), np.int64)
    np.maximum.at(most, at, odds)
    known[at] = bags.label[kept]
    if len({*known.tolist()}) < 2:
        return adds, empty, 1.0, 0.0
    weight = np.where(known == 1, share / known.mean(), ALARM * (1 - share) / (1 - known.mean()))
    return *train(bags, np.arange(len(bags))), *calibrated(most, known, weight)


def score(docs: DataFrame, model: tuple[np.ndarray, float, float, float], name: str = "score") -> DataFrame:
    """``docs`` and a column ``name``: the probability of class 1, from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adds, empty, scale, offset = shared.value
        for batch in batches:
            out = np.empty(batch.num_rows)
            for first, end, data, offsets in text_chunks(batch, limit=CHUNK_BYTES):
                passages, buckets, weights, firsts = subword_bags(data, offsets)
                odds = np.maximum.reduceat(np.bincount(passages, weights * adds[buckets], firsts[-1]), firsts[:-1]) + empty
                out[first:end] = 1 / (1 + np.exp(-np.clip(scale * odds + offset, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])

    return docs.mapInArrow(lambda batches: trimmed(scored(batches)), with_column(docs, name, "double"))


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> DataFrame:
    """``(doc_id, score)`` of every row of ``docs``, by a model of the labels ``toxic`` that ``learn`` admits."""
    return score(docs.select("doc_id", "text"), fit(docs, labels, "toxic", learn, per_class)).select("doc_id", "score")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The scores with held-out rows marked: those whose remainder is 0 are not learned from."""
    key = remainder(F.col("doc_id"), 5)
    return toxicity(docs, labels, key != 0).select(
        "doc_id", F.coalesce(key == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
