"""Ranges of a whole-number key that are the same at every run.

Spark's own range partitioning samples rows by their place in a partition, so its bounds, and files written by them,
may change from one run to the next. Here the sample depends on the keys alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EACH, STEP, DEAL = 100, 64, 1 << 20


def bounds(rows: DataFrame, key: str, ranges: int) -> list[int]:
    """The keys at which the ranges but the first begin, ascending, at most ranges - 1 of them.

    About EACH keys a range, chosen by their hash and weighted by their rows, reach the driver. All rows of a key are
    in one range; null keys are in the first.
    """
    if ranges <= 1:
        return []
    share = min(DEAL, -(-DEAL * EACH * ranges // max(rows.count(), 1)))
    some = rows.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(DEAL)) < share)).groupBy(key).count().orderBy(key).collect()
    total, seen, last, out = sum(r["count"] for r in some), 0, 0, []
    for r in some:
        if (at := seen * ranges // total) > last:
            out.append(r[key])
            last = at
        seen += r["count"]
    return out


def range_of(key: Column, at: list[int]) -> Column:
    """The number of bounds at or below the key: first the run of STEP bounds, then the place in it."""
    if not at:
        return F.lit(0)
    below = lambda values: F.size(F.filter(values, lambda b: b <= key))
    heads = F.array(*(F.lit(b) for b in at[::STEP]))
    runs = F.array(*(F.array(*(F.lit(b) for b in at[i : i + STEP])) for i in range(0, len(at), STEP)))
    run = below(heads)
    return F.when(key.isNull() | (run == 0), F.lit(0)).otherwise((run - 1) * STEP + below(F.element_at(runs, F.greatest(run, F.lit(1)))))


def dealt(rows: DataFrame, key: str, ranges: int, name: str = "range") -> DataFrame:
    """rows with the number of their range, each range in a partition of its own."""
    at = bounds(rows.select(key), key, ranges)
    return rows.withColumn(name, range_of(F.col(key), at)).repartitionById(len(at) + 1, name)
