"""Joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import partitions

HOT, CHUNK = 1000, 64


def spread_join(many: DataFrame, one: DataFrame, keys: Sequence[str], n: str, by: Sequence[str]) -> DataFrame:
    """many joined to one, which has one row a key and in column n how many rows of many have that key.

    Rows of the HOT largest keys are dealt by a hash of the columns ``by`` to pieces of about CHUNK rows, at most as
    many as there are shuffle partitions, and the row of one is repeated for each piece. Any other key has less than
    one in HOT of all rows, and what is broadcast has HOT rows at most: one, which may grow with many, is merged at all
    sizes. n is dropped.
    """
    pieces = F.least(F.ceil(F.col(n) / CHUNK), F.lit(partitions(many.sparkSession))).cast("int")
    hot = F.broadcast(one.where(F.col(n) > CHUNK).orderBy(F.desc(n), *keys).limit(HOT).select(*keys, pieces.alias("_pieces")))
    dealt = many.join(hot, list(keys), "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_pieces")).cast("int"), F.lit(0))).drop("_pieces")
    each = one.join(hot, list(keys), "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces", n)
    return dealt.join(each.hint("merge"), [*keys, "_piece"]).drop("_piece")
