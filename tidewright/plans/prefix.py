"""Ordered work along keys of any size: places, running sums, composed steps and trailing windows.

A window over a key is one task a key. Here rows are put in order once, over ranges that cut through keys; each range
works by itself, and what it needs from the ranges before it (a count, a sum, a composed step) is a row a range that is
carried on. So one key with all rows is shared by all tasks, and nothing that is carried grows with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import BITS
from .shared import staged

PART, AT = "_part", "_at"
SIZE = 256


def ordered(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df written in ranges of (key, order), with its range (_part) and its place in it (_at); order must be total within a key."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(df.repartitionByRange(n, *key, *order).sortWithinPartitions(*key, *order).withColumn(AT, F.monotonically_increasing_id()))
    return placed.withColumn(PART, F.shiftright(AT, BITS))


def carried(rows: DataFrame, key: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """key, _part and the sums over the key's rows in earlier ranges, for the ranges in which a key goes on.

    A range has at most one key that began before it, so there is at most one row a range.
    """
    parts = rows.groupBy(*key, PART).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = Window.partitionBy(*key).orderBy(PART)
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*key, PART, F.row_number().over(before).alias("_nth"), *(F.sum(n).over(earlier).alias(n) for n in sums)).where("_nth > 1").drop("_nth")


def running(df: DataFrame, key: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """df with the running sum of each column of sums, the row included; null counts as nothing, and no row yet as 0."""
    rows = ordered(df.withColumns({f"_of_{n}": c for n, c in sums.items()}), key, order)
    added = {n: F.coalesce(F.col(f"_of_{n}"), F.lit(0)) for n in sums}
    within = Window.partitionBy(*key, PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    carry = carried(rows, key, {f"_carry_{n}": c for n, c in added.items()})
    same = [F.col(f"_r.{k}").eqNullSafe(F.col(f"_c.{k}")) for k in (*key, PART)]
    joined = rows.withColumns({n: F.sum(c).over(within) for n, c in added.items()}).alias("_r").join(F.broadcast(carry).alias("_c"), _all(same), "left")  # a row a range
    totals = {n: F.coalesce(F.col(f"_r.{n}") + F.col(f"_carry_{n}"), F.col(f"_r.{n}")) for n in sums}
    return joined.select(*(F.col(f"_r.`{c}`").alias(c) for c in df.columns), *(c.alias(n) for n, c in totals.items()))


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with the place of each row in its key, from 0."""
    return running(df, key, order, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)


def following(df: DataFrame, key: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """df with the last known value of a column in the row's key, at or before the row; null before any."""
    rows = ordered(df, key, order)
    last = rows.groupBy(*key, PART).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(AT))).alias("_last"))
    earlier = Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = last.withColumn("_carry", F.last("_last", True).over(earlier)).where("_carry is not null").drop("_last").alias("_c")  # at most a row a range
    within = Window.partitionBy(*key, PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"_r.{k}").eqNullSafe(F.col(f"_c.{k}")) for k in (*key, PART)]
    joined = rows.withColumn("_own", F.last(column, True).over(within)).alias("_r").join(F.broadcast(carry), _all(same), "left")
    return joined.select(*(F.col(f"_r.`{c}`").alias(c) for c in df.columns), F.coalesce("_own", "_carry").alias(name))


def trailing(df: DataFrame, key: Sequence[str], order: Sequence[str], rows: int, columns: Mapping[str, Callable[[Window], Column]], length: int = 4096) -> DataFrame:
    """df with columns over the last ``rows`` rows of the key, the row included: each of columns makes one from a window.

    Keys are cut into stretches of ``length`` rows, each with a copy of the rows - 1 before it.
    """
    length = max(length, rows)
    placed = numbered(df, key, order, AT)
    own = F.floor(F.col(AT) / length)
    halo = (F.pmod(F.col(AT), F.lit(length)) > length - rows) & (F.lit(rows) > 1)
    copies = F.explode(F.when(halo, F.array(own, own + 1)).otherwise(F.array(own)))
    over = Window.partitionBy(*key, "_stretch").orderBy(AT).rowsBetween(1 - rows, 0)
    dealt = placed.select("*", copies.alias("_stretch"))
    return dealt.withColumns({n: f(over) for n, f in columns.items()}).where(F.col("_stretch") == own).drop(AT, "_stretch")


def prefixes(df: DataFrame, key: Sequence[str], order: Sequence[str], step: Column, unit: Column, compose: Callable[[Column, Column], Column], name: str, size: int = SIZE) -> DataFrame:
    """df with the composition of the steps of all earlier rows of the key (unit for the first row).

    Steps are values of one type that compose(first, then) combines, in any grouping: maps over the states of a finite
    machine, affine maps, sums. Rows are composed in blocks of ``size`` along the key, blocks of blocks in turn until
    a key has one, and what comes before a block is handed down again; a block is all that is ever held at once.
    """
    placed = numbered(df.withColumn("_step", step), key, order, AT)
    out = _scanned(placed, key, unit, compose, size)
    return out.select(*df.columns, F.col("_before").alias(name))


def _scanned(rows: DataFrame, key: Sequence[str], unit: Column, compose: Callable[[Column, Column], Column], size: int) -> DataFrame:
    """rows (key, _at from 0, _step, ...) with _before, the composition of the steps before _at."""
    whole = F.struct(*(c for c in rows.columns if c not in key and c not in (AT, "_step")), F.lit(True).alias("_is"))
    block = F.floor(F.col(AT) / size)
    items = sorted_by(AT, F.collect_list(F.struct(AT, "_step", whole.alias("_row"))))  # size rows at the most
    blocks = rows.groupBy(*key, block.alias("_block")).agg(items.alias("_items"))
    kind = rows.schema["_step"].dataType
    start = F.struct(unit.cast(kind).alias("all"), F.array().cast(f"array<{kind.simpleString()}>").alias("each"))
    done = F.aggregate("_items", start, lambda a, x: F.struct(compose(a["all"], x["_step"]).cast(kind).alias("all"), F.array_append(a["each"], a["all"]).alias("each")))
    blocks = staged(blocks.withColumn("_done", done))
    if blocks.where("_block > 0").isEmpty():
        blocks = blocks.withColumn("_ahead", unit.cast(kind))
    else:
        totals = blocks.select(*key, F.col("_block").alias(AT), F.col("_done.all").alias("_step"))
        ahead = _scanned(totals, key, unit, compose, size).select(*(F.col(k).alias(f"_of_{k}") for k in key), F.col(AT).alias("_of_block"), F.col("_before").alias("_ahead"))
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in key] + [F.col("_block") == F.col("_of_block")]
        blocks = blocks.join(ahead, _all(same)).drop("_of_block", *(f"_of_{k}" for k in key))
    each = blocks.select(*key, "_ahead", F.explode(F.arrays_zip(F.col("_items"), F.col("_done.each").alias("each"))).alias("_x"))
    return each.select(*key, F.col(f"_x._items.{AT}").alias(AT), F.col("_x._items._step").alias("_step"), *(F.col(f"_x._items._row.`{c}`").alias(c) for c in rows.columns if c not in key and c not in (AT, "_step")), compose(F.col("_ahead"), F.col("_x.each")).alias("_before"))


def sorted_by(field: str, items: Column) -> Column:
    """An array of structs by one of their fields; the others may be of types without an order, as maps are."""
    return F.array_sort(items, lambda x, y: F.when(x[field] < y[field], -1).when(x[field] > y[field], 1).otherwise(0))


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
