"""Importance resampling towards a target: documents whose hashed word features look like the target's are drawn.

A vectorised byte automaton reads Arrow's UTF-8 buffers: a lookup table classifies and folds every byte, differences
of the classes are the words' bounds, and the CRCs of all words advance by one byte a step, from one table, at once.
Every document of the corpus and of the target is counted; log ratios of the two bucket histograms are the gains, a
document's weight is their floored mean, and a Gumbel draw from its id makes the highest scores a sample without
replacement in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranks import global_rank
from ._bytes import Terms, slices
from ._shared import staged, table

BUCKETS, MOST_WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
STEPS = 64  # bytes of a word that advance together; the rest of the few longer ones goes one by one


def _crc_table() -> np.ndarray:
    """The table of CRC-32 (reflected polynomial 0xEDB88320)."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


CRC = _crc_table()


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for each start, going on from the CRC-32 in state (0 for nothing before)."""
    lengths = ends - starts
    order = np.argsort(-np.minimum(lengths, STEPS), kind="stable")  # those with bytes left are the first
    at, crc = starts[order], ~state[order].astype(np.uint32)
    left = np.bincount(np.minimum(lengths, STEPS), minlength=STEPS + 1)
    active = len(at) - np.cumsum(left)
    for k in range(STEPS):
        if not (m := int(active[k])):
            break
        crc[:m] = CRC[(crc[:m] ^ data[at[:m] + k]) & np.uint32(0xFF)] ^ (crc[:m] >> np.uint32(8))
    out = np.empty(len(starts), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(lengths > STEPS).tolist():
        out[i] = zlib.crc32(data[starts[i] + STEPS : ends[i]].tobytes(), int(out[i]))
    return out


def features(texts: pa.Array, most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature, and the words of each text: runs of 1 to most_words words, joined by one space."""
    w = Terms(texts)
    text, n = w.text(), len(w.starts)
    state, of, out = np.zeros(n, np.uint32), [], []
    for k in range(most_words):
        if k:  # one space, then the word after the run
            if n <= k:
                break
            longer = text[: n - k] == text[k:]
            state = state[: n - k]
            state = ~(CRC[(~state ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (~state >> np.uint32(8)))
            state = advance(state, w.data, w.starts[k:], w.ends[k:])
            of.append(text[: n - k][longer])
            out.append(state[longer])
        else:
            state = advance(state, w.data, w.starts, w.ends)
            of.append(text)
            out.append(state)
    return np.concatenate(of or [text]), (np.concatenate(out or [state]) % np.uint32(buckets)).astype(np.int64), w.counts


def histogram(docs: DataFrame, most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts fall into each bucket: one row a bucket and task is summed, buckets numbers are returned."""

    def run(parts):
        total = np.zeros(buckets, np.int64)
        for part in parts:
            for _, some in slices(part.column(0)):
                total += np.bincount(features(some, most_words, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = [0] * buckets
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket."""
    s, t, k = float(sum(corpus)), float(sum(target)), float(len(corpus))
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(corpus, target)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of docs."""

    def run(parts):
        for part in parts:
            words, n, weight = [], [], []
            for _, some in slices(part.column(1)):
                of, bucket, counts = features(some, most_words, len(gain))
                size = np.bincount(of, minlength=len(some))
                total = np.zeros(len(some), np.int64)
                np.add.at(total, of, gain[bucket])
                words.append(counts)
                n.append(size)
                weight.append(np.floor_divide(total, np.maximum(size, 1)))
            join = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), join(words), join(n), join(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs (doc_id, text) against target (text).

    percent of the rows with at least least_words words are drawn, floored: rank is 1, 2, 3 ... by falling score, ties
    to the smaller doc_id, and null for all others. Null and empty texts have no feature, weight 0 and no rank. Texts
    of any length are read whole. Rows that repeat a doc_id share its draw and are ranked each; a null doc_id draws as
    an empty one and loses ties. Other columns are not read, whatever their names. Empty tables: no rows of docs, no
    result; an empty target leaves the smoothed shares, so rare features weigh more.
    """
    gain = gains(histogram(docs, most_words, buckets), histogram(target, most_words, buckets))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((drawn + 0.5) / 4294967296.0))).cast("long")
    rows = staged(weigh(docs, gain, most_words).withColumn("score", F.col("weight") + noise), "weighed")
    able = rows.where(F.col("n_words") >= least_words)
    most = able.count() * percent // 100
    order = ["_falling", "_no_id", "doc_id", "n_features", "weight"]
    ranked = global_rank(able.withColumns({"_falling": -F.col("score"), "_no_id": F.col("doc_id").isNull()}), order, "rank", first=1).drop("_falling", "_no_id")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")).cast("long"))
    return ranked.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op12_importance": op12_importance}
ORACLES: dict[str, str] = {}  # DuckDB has no crc32: tests/llm holds it against a plain version
