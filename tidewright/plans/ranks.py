"""Global row numbers without a single sorting task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import staged

BITS = 33  # Spark's increasing ids: the partition above, the row in it below


def global_rank(df: DataFrame, order: list[str | Column], name: str, first: int = 0) -> DataFrame:
    """df with a number for each row in the given order, which must be total for reruns to agree.

    Rows are range-partitioned, sorted and written once with their place, since Spark draws the ranges anew for each
    plan that reads them. The ranges' counts, one row a partition, give each range its offset.
    """
    at = "_at"
    while at in df.columns:
        at = f"_{at}"
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part, before = F.shiftright(at, BITS), Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    number = F.col(at) - F.shiftleft(F.col("_part"), BITS) + F.col("_offset") + first
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, number).drop(at, "_part", "_offset")
