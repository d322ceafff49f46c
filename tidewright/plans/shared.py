"""Tables written to the folder that the cluster shares, to cut lineage so that lost executors lose nothing."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """df written below spark.checkpoint.dir and read back; a temporary folder only where that is unset on one machine."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = posixpath.join(base, f"tidewright-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
