"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network.

A word stands for two terms: its hash bucket and its shape (kinds of its first and last byte, length). Each
term has a fixed sparse ternary index vector; a term's context vector is the sum of the index vectors of the
terms up to two words away, over all documents. Words that share one of the BUCKETS share a vector: the table has a
fixed size, whatever the vocabulary. A document pools the context vectors of its words and the index vectors of their
shapes. The network is trained on the driver on the pooled rows of a bounded sample of labelled documents, and a
temperature fitted on a part that it hasn't seen calibrates its probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labels import remainder, sample
from ._shared import partitions, quoted, staged, table
from ._words import Words, groups

MOST_LABELLED = 12_000  # rows that the classifier is fitted on, at most
BUCKETS, KINDS, LENGTHS, DIM, WINDOW = 1 << 14, 9, 4, 32, 2
SHAPES = KINDS * KINDS * LENGTHS
THRESHOLD = 0.3

#: The kind of a byte: lower, upper, digit, sentence mark, exclamation or question, bracket or quote, other mark, pipe or angle, beyond ASCII.
KIND = np.full(256, 6, np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "()[]{}'\"")):
    KIND[list(_chars.encode())] = _k
KIND[list(b"|<>")] = 7
KIND[128:] = 8


def index_vectors(terms: int, dim: int = DIM, ones: int = 4, seed: int = 7) -> np.ndarray:
    """Sparse ternary rows: half of the ones are +1, half -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((terms, dim), np.float32)
    at = np.argsort(rng.random((terms, dim)), axis=1)[:, :ones]
    np.put_along_axis(out, at, np.tile(np.repeat([1.0, -1.0], ones // 2), (terms, 1)).astype(np.float32), axis=1)
    return out


INDEX = index_vectors(BUCKETS + SHAPES)
INDEX_BYTES = INDEX.astype(np.int8)


def terms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, shape term) of every word."""
    length = w.ends - w.starts
    size = np.searchsorted(np.array([3, 7, 12]), length)
    shape = (KIND[w.data[w.starts]] * KINDS + KIND[w.data[w.ends - 1]]) * LENGTHS + size
    return (w.hashes >> np.uint64(50)).astype(np.int64), BUCKETS + shape


def context_sums(w: Words, out: np.ndarray) -> None:
    """Adds to out, whole numbers, the index vectors around each term of these texts."""
    bucket, shape = terms(w)
    n = len(bucket)
    if n < 2:
        return
    own = INDEX_BYTES[bucket] + INDEX_BYTES[shape]
    around = np.zeros((n, DIM), np.int8)  # at most 2 * WINDOW words of two terms each
    for d in range(1, min(WINDOW, n - 1) + 1):
        near = (w.text[d:] == w.text[:-d])[:, None].astype(np.int8)
        around[d:] += own[:-d] * near
        around[:-d] += own[d:] * near
    for term in (bucket, shape):
        order = np.argsort(term, kind="stable")
        which, first = np.unique(term[order], return_index=True)
        out[which] += np.add.reduceat(around[order], first, axis=0, dtype=np.int64)


def unit_rows(sums: np.ndarray) -> np.ndarray:
    norm = np.sqrt((sums * sums).sum(1, keepdims=True))
    return np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0).astype(np.float32)


def pooled(w: Words, vectors: np.ndarray) -> np.ndarray:
    """One row a text: means of context vectors of words and shapes, of shapes' index vectors, and three scalars."""
    bucket, shape = terms(w)
    out = np.zeros((w.n, 3 * DIM + 3))
    full = np.flatnonzero(w.counts)
    if len(full):
        each = w.counts[full][:, None]
        # shapes are few: count them by text instead of adding rows of vectors
        counts = np.bincount(w.text * SHAPES + (shape - BUCKETS), minlength=w.n * SHAPES).reshape(w.n, SHAPES)[full]
        out[full, :DIM] = np.add.reduceat(vectors[bucket], w.first[full], axis=0) / each
        out[full, DIM : 2 * DIM] = counts @ vectors[BUCKETS:] / each
        out[full, 2 * DIM : 3 * DIM] = counts @ INDEX[BUCKETS:] / each
        same = np.zeros(len(bucket))
        same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.text[1:] == w.text[:-1])
        out[full, -3] = np.add.reduceat(same, w.first[full]) / each[:, 0]
        out[full, -2] = np.linalg.norm(out[full, :DIM], axis=1)
    out[:, -1] = np.log1p(w.counts)
    return out


@dataclass
class Network:
    """Scores pooled rows: standardised, one tanh layer, one logit, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) * self.scale) @ self.w1 + self.b1)
        return (h @ self.w2 + self.b2) / self.temperature

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Network:
    """Adam on cross-entropy. With no rows, or rows of one label, the logit is that of the (smoothed) label share."""
    rng, n, d = np.random.default_rng(seed), len(x), x.shape[1]
    share = (y.sum() + 1) / (n + 2)
    mean, spread = (x.mean(0), x.std(0)) if n else (np.zeros(d), np.ones(d))
    net = Network(mean, 1 / np.where(spread > 1e-9, spread, 1.0), rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return net
    z = (x - net.mean) * net.scale
    net.w2 = rng.normal(0, hidden**-0.5, hidden)
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v = [np.zeros_like(a) for a in weights], [np.zeros_like(a) for a in weights]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in (order[i : i + batch] for i in range(0, n, batch)):
            a, t = z[at], y[at]
            h = np.tanh(a @ weights[0] + weights[1])
            p = 1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3][0], -30, 30)))
            g = (p - t) / len(at)
            back = np.outer(g, weights[2]) * (1 - h * h)
            grads = [a.T @ back + decay * weights[0], back.sum(0), h.T @ g + decay * weights[2], np.array([g.sum()])]
            step += 1
            for w, gr, mm, vv in zip(weights, grads, m, v):
                mm += 0.1 * (gr - mm)
                vv += 0.001 * (gr * gr - vv)
                w -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    return net


def calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """The temperature of least cross-entropy on rows that training did not see; with too few, the network as it is."""
    if len(y) < 20 or y.min() == y.max():
        return net
    logits, grid = net.logits(x), np.exp(np.linspace(np.log(0.25), np.log(8), 80))
    loss = [float(np.mean(np.logaddexp(0, logits / t) - y * logits / t)) for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.network.score(pooled(Words(texts), self.vectors))


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The context vectors of all terms over every text of docs.

    Each task sums its texts into one table of (BUCKETS + SHAPES) * DIM numbers and emits the rows that are not zero;
    Spark adds those up by term, so the driver gets one table whatever the input.
    """
    columns = [f"d{k}" for k in range(DIM)]

    def run(parts):
        total = np.zeros((BUCKETS + SHAPES, DIM), np.int64)
        for part in parts:
            for _, texts in groups(part.column(0), 150_000):
                context_sums(Words(texts), total)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(total[some, k], pa.int64()) for k in range(DIM))], names=["term", *columns])

    partial = docs.select("text").where("text is not null").mapInArrow(run, "term int, " + ", ".join(f"{c} long" for c in columns))
    got = partial.groupBy("term").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()  # a row a term at most
    sums = np.zeros((BUCKETS + SHAPES, DIM))
    sums[got["term"].to_numpy(int)] = got[columns].to_numpy(float)
    return unit_rows(sums)


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> QualityModel:
    """Context vectors of all documents, and a network fitted on at most ``most`` labelled ones that are not held out.

    A fifth of the labelled documents sets the temperature. Executors count contexts and pool the sample; the driver
    gets the summed table and one short row a labelled document. Null, empty, repeated and very long texts count by
    their words. Rows that share an id with contradictory labels (ties) are left out. Without documents or labels, or
    with one label only, every text scores the smoothed share of the labels. Only doc_id and text are read, and
    doc_id and quality of labels, whatever other columns there are.
    """
    spark = docs.sparkSession
    vectors = context_vectors(docs)
    rows = staged(sample(docs, labels, most).repartition(partitions(spark), "doc_id"), "labelled")
    tuned = remainder("doc_id") == 1
    shared = spark.sparkContext.broadcast(vectors)

    def pool(parts):
        for part in parts:
            texts = part.column(3)
            x = np.concatenate([pooled(Words(t), shared.value) for _, t in groups(texts)]) if len(texts) else np.zeros((0, 3 * DIM + 3))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "tuned", "x"])

    got = rows.select("doc_id", F.col("label").cast("int").alias("label"), tuned.alias("tuned"), "text").mapInArrow(pool, "doc_id long, label int, tuned boolean, x array<double>").toPandas()
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, 3 * DIM + 3))
    order = np.lexsort((*x.T[-3:], got["doc_id"].to_numpy())) if len(got) else np.zeros(0, int)
    x, y, t = x[order], got["label"].to_numpy(float)[order], got["tuned"].to_numpy(bool)[order]
    return QualityModel(vectors, calibrate(train(x[~t], y[~t]), x[t], y[t]))


def with_score(docs: DataFrame, model: QualityModel, keep: list[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` of docs (text, ...) and the score.

    Null texts score as empty ones, which score too; a text of any length is pooled whole. Rows that repeat score the
    same (ties have no order here). Columns may have any name but ``name``. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*map(quoted, keep))

    def run(parts):
        for part in parts:
            scores = [shared.value.score(t) for _, t in groups(part.column(1))]
            yield pa.RecordBatch.from_arrays([*part.column(0).flatten(), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*keep, name])

    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.select(F.struct(*map(quoted, keep)).alias("row"), F.col("text")).mapInArrow(run, schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = with_score(docs, fit_quality(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLES: dict[str, str] = {}
