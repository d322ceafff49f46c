"""Mixing sources to target weights by the cube method.

Every document's share is its source's target over its source's size: the whole part of the share is taken
as whole copies, the rest is an inclusion probability. The flight phase moves the probabilities of three
documents at a time along the null space of the two constraints (words, documents) until one of them is 0 or
1, so both totals of a source stay exact while all but two documents of a group are decided. Groups are hash
buckets of a source; what they leave open is dealt into fewer groups and flies again, until one group a
source is left, where the last two and a dozen held back land together on the nearest totals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import quoted, staged, table
from ._skew import HOT

WEIGHTS, MOST_COPIES = (5, 2, 1), 3
GROUP, LANDING = 2048, 12
NO_ID = -(1 << 63)  # stands for a null doc_id inside the groups


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, n_docs and target (double) for rows of source and size (one row a source comes out).

    Sources in order of their UTF-8 bytes, which is code point order, nulls last, take the weights in turn. All
    words are shared by weight; a target stops at most times its source, and the excess goes to the others by weight.
    The windows run over one row a source, in one task: sources are meant to be the few corpora of a mix.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    totals = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    totals = totals.withColumn("most", F.col("source_size").cast("double") * most)
    # those that stop are a prefix by most / weight; before each, what is left of words and weight
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    totals = totals.withColumn("stops", F.col("most") * weight_left < F.col("weight") * left)
    stopped = lambda c: F.coalesce(F.sum(F.when(F.col("stops"), F.col(c))).over(everything), F.lit(0.0))
    share = (F.sum("source_size").over(everything) - stopped("most")) / (F.sum("weight").over(everything) - stopped("weight"))
    return totals.withColumn("share", F.when(F.col("stops"), 0.0).otherwise(share)).select("source", "source_size", "n_docs", F.when(F.col("stops"), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("share"))).alias("target"))


def fly(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase over one group: sums of p and of p * size are kept; at most two entries stay fractional."""
    size, p, draws = size.tolist(), p.tolist(), rng.random(len(p) + 1).tolist()
    held: list[int] = []
    for new in range(len(p)):
        held.append(new)
        if len(held) < 3:
            continue
        i, j, k = held
        a, b, c = size[i], size[j], size[k]
        u = (b - c, c - a, a - b) if a != b or b != c else (1.0, -1.0, 0.0)
        up = min((1 - p[x]) / v if v > 0 else p[x] / -v for x, v in zip(held, u) if v)
        down = min(p[x] / v if v > 0 else (1 - p[x]) / -v for x, v in zip(held, u) if v)
        step = up if draws[new] * (up + down) < down else -down
        for x, v in zip(held, u):
            p[x] += step * v
            if v and (p[x] < 1e-9 or p[x] > 1 - 1e-9):
                p[x] = float(round(p[x]))
        held = [x for x in held if 0 < p[x] < 1]
    return np.array(p)


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The last few fractional entries as 0 or 1: of all ways the one whose sums of p * size and p are nearest."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    ways = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1).astype(float)
    moved = ways - p[open_]
    p = p.copy()
    p[open_] = ways[np.argmin(np.abs(moved @ size[open_]) + np.abs(moved.sum(1)))]
    return p


def _flight(keys: list[str], most: int, seed: int):
    """The flight over one group; in a source's last group, LANDING documents of all sizes wait for the landing."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "row"], kind="stable")
        rng = np.random.default_rng([seed, abs(int(group["order"].iloc[0])), len(group)])
        size, p, last = group["size"].to_numpy(float), group["p"].to_numpy(float).copy(), group["n_docs"].iloc[0] <= most
        moved = np.flatnonzero((p > 0) & (p < 1))
        if last:
            by_size = moved[np.argsort(size[moved], kind="stable")]
            moved = np.setdiff1d(moved, by_size[np.unique(np.linspace(0, len(by_size) - 1, LANDING).astype(int))] if len(by_size) else by_size)
        p[moved] = fly(size[moved], p[moved], rng)
        return group.assign(p=land(size, p) if last else p)[keys]

    return run


def draw(docs: DataFrame, columns: list[str], weights=WEIGHTS, most: int = MOST_COPIES, seed: int = 0, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(rows, drawn): rows has every row of docs with a number, row, and its columns in a struct, held; drawn has row,
    doc_id, source, size, source_size, target and copies of each."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    # rows are numbered where they are written, so the number is the same for all that read it
    held = F.struct(*map(quoted, columns)) if columns else F.lit(None).cast("int")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "source", words.alias("size"), F.xxhash64("text").alias("text_hash"), held.alias("held"))
    rows = staged(rows.withColumn("order", F.xxhash64("doc_id", "size", "text_hash", F.lit(seed))), "sizes")
    targets = staged(source_targets(rows, weights, most), "targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("share", share).withColumnRenamed("source", "of")
    joined = rows.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of", "held")
    whole = F.least(F.floor("share"), F.lit(most))
    open_ = joined.withColumns({"whole": whole.cast("int"), "p": F.when(F.col("size") > 0, F.least(F.col("share") - whole, F.lit(1.0))).otherwise(0.0)})
    # rows that repeat id and text thousands of times would all hash to one group: those are dealt by their number too
    same = rows.groupBy("order").agg(F.count("*").alias("n")).where(F.col("n") > group).orderBy(F.desc("n"), "order").limit(HOT)
    open_ = open_.join(F.broadcast(same.select("order", F.ceil(F.col("n") / group).alias("pieces"))), "order", "left")
    open_ = open_.withColumn("deal", F.xxhash64("order", F.coalesce(F.pmod("row", "pieces"), F.lit(0))))
    keys = ["row", "doc_id", "source", "size", "source_size", "target", "whole", "p", "order", "deal"]
    kinds = "row long, doc_id long, source string, size long, source_size long, target double, whole int, p double, order long, deal long"
    done, n, level = [], F.ceil(F.col("n_docs") / group), 0
    todo = open_.select(*keys, "n_docs")
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    while True:
        dealt = todo.withColumn("bucket", F.pmod(F.xxhash64("deal", F.lit(level)), n))
        flown = staged(dealt.groupBy("source", "bucket").applyInPandas(_flight(keys, group, seed + level), kinds), f"flight-{level}")
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.where(~undecided))
        if largest <= group:
            break
        left = flown.where(undecided)
        counts = staged(left.groupBy("source").agg(F.count("*").alias("n_docs")).withColumnRenamed("source", "of"), f"left-{level}")
        largest, level = counts.agg(F.max("n_docs")).first()[0] or 0, level + 1
        todo = left.join(counts, F.col("source").eqNullSafe(F.col("of"))).select(*keys, "n_docs")
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    copies = (F.col("whole") + F.col("p").cast("int")).cast("int")
    return rows, out.select("row", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: int = 0, group: int = GROUP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of docs (doc_id, text, source).

    A null text has size 0 and is taken 0 words; texts of any length are counted whole. A null source is a source of
    its own. Rows that repeat an id, or have none, are drawn each for itself. The draw depends on doc_id, text and
    seed, and for rows equal in those (ties) on their place in the input, so reruns agree. Other columns are not read,
    whatever their names. An empty table gives no rows, a table of empty texts takes nothing.
    """
    return draw(docs, [], weights, most, seed, group)[1].select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def take(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: int = 0, group: int = GROUP) -> DataFrame:
    """Each row of docs as often as the mix takes it, with all its columns, whatever their names."""
    rows, drawn = draw(docs, docs.columns, weights, most, seed, group)
    taken = rows.select("row", "held").join(drawn.where("copies > 0").select("row", "copies"), "row")
    return taken.select("held", F.explode(F.sequence(F.lit(1), "copies"))).select("held.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_mixing": op9_mixing}
ORACLES: dict[str, str] = {}
