"""Quality from random-indexing word vectors, pooled per document, and a two-layer network with calibrated odds.

Every token has a fixed sparse index vector of +1 and -1; its word vector is the sum of the index vectors
of the tokens beside it, over all documents of the corpus, log-scaled and brought to unit length. Tokens (runs of
letters and digits, runs of other signs) share ``BUCKETS`` vectors by hash, so that the table is of one
size whatever the corpus: every task sums its own, Spark adds them up, and ``BUCKETS * WIDTH`` numbers
reach the driver. A document is the mean and the spread of its tokens' vectors.

A network of two layers is trained in numpy on a bounded sample of labelled documents (``PER_CLASS`` of
each class, documented limit of the fit); a fifth of it is kept for the temperature that calibrates the
probabilities. The word vectors come from all texts and no labels.

Null and empty texts are the document without tokens (all zeros) and get its score. Without labels of
both classes every score is the share of class 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiercurve.llm.common import Words, byte_set, labelled_sample, mix, remainder, text_chunks, with_column

PER_CLASS = 6000
BUCKETS, WIDTH, NONZERO, REACH = 4096, 32, 4, 2
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
SIGNS = byte_set((0x21, 0x7E)) & ~ALNUM


def index_vectors() -> np.ndarray:
    """The sparse index vector of each bucket: ``NONZERO`` entries of +1 or -1, by a fixed draw."""
    random = np.random.default_rng(11)
    vectors = np.zeros((BUCKETS, WIDTH), np.float32)
    places = np.argsort(random.random((BUCKETS, WIDTH)), 1)[:, :NONZERO]
    vectors[np.arange(BUCKETS)[:, None], places] = random.choice([-1, 1], (BUCKETS, NONZERO))
    return vectors


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(document, bucket)`` of every token in the order of the text."""
    parts = [Words(data, offsets, kind) for kind in (ALNUM, SIGNS)]
    order = np.argsort(np.concatenate([p.start for p in parts]), kind="stable")
    buckets = np.concatenate([mix(p.hashes()) & np.uint64(BUCKETS - 1) for p in parts]).astype(np.int64)
    return np.concatenate([p.documents() for p in parts])[order], buckets[order]


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = index_vectors()
    counts = np.zeros((BUCKETS, WIDTH))
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch):
            documents, buckets = tokens(data, offsets)
            for apart in range(1, REACH + 1):
                same = documents[:-apart] == documents[apart:]
                left, right = buckets[:-apart][same], buckets[apart:][same]
                pairs, times = np.unique(np.concatenate([left * BUCKETS + right, right * BUCKETS + left]), return_counts=True)
                token, near = pairs // BUCKETS, pairs % BUCKETS
                cut = np.flatnonzero(np.diff(token, prepend=-1))
                if len(cut):
                    counts[token[cut]] += np.add.reduceat(index[near] * times[:, None], cut, axis=0)
    rows = np.flatnonzero(counts.any(1))
    columns = [pa.array(rows.astype(np.int32)), *(pa.array(counts[rows, j]) for j in range(WIDTH))]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", *(f"v{j}" for j in range(WIDTH))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The word vector of every bucket, from all texts of ``docs``."""
    names = [f"v{j}" for j in range(WIDTH)]
    schema = "bucket int, " + ", ".join(f"{n} double" for n in names)
    sums = docs.select("text").mapInArrow(_beside, schema).groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names))
    vectors = np.zeros((BUCKETS, WIDTH))
    for row in sums.collect():  # BUCKETS rows at most
        vectors[row[0]] = row[1:]
    vectors = np.sign(vectors) * np.log1p(np.abs(vectors))
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each document, zeros where there is no token."""
    documents, buckets = tokens(data, offsets)
    out = np.zeros((len(offsets) - 1, 2 * WIDTH), np.float32)
    for first in range(0, len(out), 256):
        end = min(first + 256, len(out))
        a, b = np.searchsorted(documents, [first, end])
        held = np.bincount((documents[a:b] - first) * BUCKETS + buckets[a:b], minlength=(end - first) * BUCKETS)
        held = held.reshape(end - first, BUCKETS).astype(np.float32)
        total = np.maximum(held.sum(1, keepdims=True), 1)
        mean = held @ vectors / total
        spread = np.sqrt(np.maximum(held @ (vectors * vectors) / total - mean * mean, 0))
        out[first:end] = np.concatenate([mean, spread], 1)
    return out


def _network(x: np.ndarray, model: dict) -> np.ndarray:
    hidden = np.maximum((x - model["mean"]) / model["scale"] @ model["w1"] + model["b1"], 0)
    return hidden @ model["w2"] + model["b2"]


def train(x: np.ndarray, label: np.ndarray, share: float, hidden: int = 32, epochs: int = 40, batch: int = 64, rate: float = 0.003) -> dict:
    """Two layers by Adam, classes weighted back to ``share``; then the temperature, on the fifth left out."""
    random = np.random.default_rng(13)
    order = random.permutation(len(x))
    kept, own = order[: len(x) // 5], order[len(x) // 5 :]
    balance = np.where(label == 1, share / max(label.mean(), 1e-9), (1 - share) / max(1 - label.mean(), 1e-9))
    model = {
        "mean": x[own].mean(0), "scale": x[own].std(0) + 1e-3, "w1": random.normal(size=(x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]),
        "b1": np.zeros(hidden), "w2": random.normal(size=hidden) * np.sqrt(1 / hidden), "b2": np.log(max(share, 1e-9) / max(1 - share, 1e-9)),
    }
    names = ("w1", "b1", "w2", "b2")
    state = {n: [0.0, 0.0] for n in names}
    step = 0
    for _ in range(max(epochs, 20000 // max(1, len(own)))):
        for at in range(0, len(own), batch):
            i = random.choice(own, batch)
            inputs = (x[i] - model["mean"]) / model["scale"]
            before = inputs @ model["w1"] + model["b1"]
            after = np.maximum(before, 0)
            error = (1 / (1 + np.exp(-np.clip(after @ model["w2"] + model["b2"], -60, 60))) - label[i]) * balance[i] / batch
            back = error[:, None] * model["w2"] * (before > 0)
            gradients = {"w1": inputs.T @ back + 1e-4 * model["w1"], "b1": back.sum(0), "w2": after.T @ error + 1e-4 * model["w2"], "b2": error.sum()}
            step += 1
            for n in names:
                state[n][0] = 0.9 * state[n][0] + 0.1 * gradients[n]
                state[n][1] = 0.99 * state[n][1] + 0.01 * gradients[n] ** 2
                model[n] = model[n] - rate * state[n][0] / (1 - 0.9**step) / (np.sqrt(state[n][1] / (1 - 0.99**step)) + 1e-8)
    logits, truth, weight = _network(x[kept], model), label[kept], balance[kept]
    losses = {t: np.sum(weight * np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / t)) for t in np.geomspace(0.25, 8, 61)}
    return model | {"temperature": min(losses, key=losses.get)}


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int = PER_CLASS) -> dict:
    """Word vectors of all of ``docs`` and a network trained on the labels that ``learn`` (on ``doc_id``) admits."""
    vectors = word_vectors(docs)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch):
                x = pooled(data, offsets, vectors)
                known = batch.column(batch.schema.get_field_index("label")).slice(first, end - first).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([known, pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])

    sample, counts = labelled_sample(docs, labels, label, learn, per_class)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    rows = sorted((r[0], bytes(r[1])) for r in sample.select("text", "label").mapInArrow(features, "label int, x binary").collect())
    known = np.array([r[0] for r in rows], float)
    if len(set(known)) < 2 or len(rows) < 10:
        odds = float(np.log(max(share, 1e-9)) - np.log(max(1 - share, 1e-9)))
        flat = {"mean": 0.0, "scale": 1.0, "w1": np.zeros((2 * WIDTH, 1)), "b1": 0.0, "w2": np.zeros(1), "b2": odds, "temperature": 1.0}
        return flat | {"vectors": vectors}
    x = np.stack([np.frombuffer(r[1], np.float32) for r in rows]).astype(float)
    return train(x, known, share) | {"vectors": vectors}


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``docs`` and a column ``name``: the calibrated probability of class 1, from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = np.empty(batch.num_rows)
            for first, end, data, offsets in text_chunks(batch):
                logits = _network(pooled(data, offsets, own["vectors"]), own) / own["temperature"]
                out[first:end] = 1 / (1 + np.exp(-np.clip(logits, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])

    return docs.mapInArrow(scored, with_column(docs, name, "double"))


def quality(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> DataFrame:
    """``(doc_id, score)`` of every row of ``docs``, by a model of the labels ``quality`` that ``learn`` admits."""
    docs = docs.select("doc_id", "text")
    return score(docs, fit(docs, labels, "quality", learn, per_class)).select("doc_id", "score")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The scores with held-out rows marked: those whose remainder is 2 are not learned from."""
    key = remainder(F.col("doc_id"), 4)
    return quality(docs, labels, key != 2).select(
        "doc_id", F.coalesce(key == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
