"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id) -> Column:
    """crc32 of the id as text, modulo 5; 0 marks the held-out documents."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def sample(docs: DataFrame, labels: DataFrame, most: int, label: str = "quality") -> DataFrame:
    """doc_id, label and text of at most ``most`` rows of labelled documents that are not held out, the same at each run.

    Null ids and labels, and ids with contradictory labels, are left out. Of rows that repeat an id each may count; rows
    are chosen by the hashes of their id and text, so however often an id repeats, no more than ``most`` rows come out.
    """
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other"))
    known = one.where((F.col("label") == F.col("other")) & (remainder("doc_id") != 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    known = F.broadcast(known.select(F.col("doc_id").alias("labelled_id"), "label"))  # most rows at the most
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_hash")]
    chosen = keyed.join(known, F.col("doc_id") == F.col("labelled_id")).orderBy(*order).limit(most)
    # equal rows are one key with a number, of which as many are taken as were chosen
    chosen = chosen.groupBy("labelled_id", "text_hash", "label").agg(F.count("*").alias("times"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), (F.col("doc_id") == F.col("labelled_id")) & (F.xxhash64("text") == F.col("text_hash")))  # most rows at the most
    once = texts.groupBy("doc_id", "label", "text_hash", "times").agg(F.min("text").alias("text"))
    return once.select("doc_id", "label", "text", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth")).drop("nth")
