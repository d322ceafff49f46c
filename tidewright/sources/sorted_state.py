"""State in key order with a manifest of each file's least and greatest key, so that reads by key open few files."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FILES = 1000  # beyond it the table is read as a whole, with the filter pushed down


def write_sorted(state: DataFrame, path: str, hidden: tuple[str, ...] = ("v:", "ttl:"), files: int | None = None) -> SortedState:
    """state (key, ...) below path in ranges of keys, sorted; keys that begin with one of ``hidden`` are not data."""
    spark = state.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    state.where("key is not null").repartitionByRange(n, "key").sortWithinPartitions("key").write.parquet(posixpath.join(path, "rows"))
    shown = F.lit(True)
    for h in hidden:
        shown = shown & ~F.startswith("key", F.lit(h))
    rows = spark.read.parquet(posixpath.join(path, "rows"))
    of = rows.groupBy(F.input_file_name().alias("file")).agg(F.min("key").alias("least"), F.max("key").alias("greatest"), F.count_if(shown).alias("data_rows"), F.min(F.when(shown, F.col("key"))).alias("least_data"), F.max(F.when(shown, F.col("key"))).alias("greatest_data"))
    of.coalesce(1).write.parquet(posixpath.join(path, "manifest"))  # a row a file
    return SortedState(spark, path, hidden)


class SortedState:
    def __init__(self, spark: SparkSession, path: str, hidden: tuple[str, ...] = ("v:", "ttl:")):
        self.spark, self.path, self.hidden = spark, path, hidden
        self.rows = spark.read.parquet(posixpath.join(path, "rows"))
        self.manifest = spark.read.parquet(posixpath.join(path, "manifest"))

    def _of(self, files: DataFrame) -> DataFrame:
        """The data rows of some files of the manifest."""
        names = [r["file"] for r in files.select("file").limit(MOST_FILES + 1).collect()]
        rows = self.rows.limit(0) if not names else self.rows if len(names) > MOST_FILES else self.spark.read.schema(self.rows.schema).parquet(*names)
        for h in self.hidden:
            rows = rows.where(~F.startswith("key", F.lit(h)))
        return rows

    def _touched(self, prefix: str) -> DataFrame:
        return self.manifest.where((F.col("greatest") >= prefix) & ((F.col("least") <= prefix) | F.startswith("least", F.lit(prefix))))

    def get(self, key: str) -> DataFrame:
        return self._of(self.manifest.where((F.col("least") <= key) & (F.col("greatest") >= key))).where(F.col("key") == key)

    def list_by_prefix(self, prefix: str) -> DataFrame:
        return self._of(self._touched(prefix)).where(F.startswith("key", F.lit(prefix)))

    def count_prefix(self, prefix: str) -> DataFrame:
        """Files whose keys all have the prefix are counted by the manifest; only those at its ends are read."""
        inside = F.startswith("least", F.lit(prefix)) & F.startswith("greatest", F.lit(prefix))
        touched = self._touched(prefix)
        ends = self._of(touched.where(~inside)).where(F.startswith("key", F.lit(prefix))).agg(F.count("*").alias("n"))
        return touched.where(inside).agg(F.coalesce(F.sum("data_rows"), F.lit(0)).alias("n")).unionAll(ends).agg(F.sum("n").alias("n"))

    def get_next(self, prefix: str, after: str | None = None) -> DataFrame:
        """The smallest data key with the prefix, above ``after`` if given: at most one file is read."""
        above = (F.col("greatest_data") > after) if after is not None and after >= prefix else (F.col("greatest_data") >= prefix)
        rows = self._of(self.manifest.where(above & ((F.col("least_data") <= prefix) | F.startswith("least_data", F.lit(prefix)))).orderBy("least").limit(1)).where(F.startswith("key", F.lit(prefix)))
        rows = rows.where(F.col("key") > after) if after is not None else rows
        return rows.orderBy("key").limit(1)


def shared_path(spark: SparkSession) -> str:
    """A new folder for such a table below spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return posixpath.join(base, f"tidewright-sorted-{uuid.uuid4().hex}")
