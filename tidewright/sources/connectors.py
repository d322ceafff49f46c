"""Sources by config, and which node runs them, as a join of configs with leases.

A factory turns a config into a streaming DataFrame; the checkpoint of its query owns its progress, so that a source
which starts again, here or on another driver, goes on where it stopped. What to start and stop is
operators.metrics.config_diff.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, config: dict) -> DataFrame:
    """{"format", "path", "schema", "options"} of a file source."""
    return spark.readStream.format(config["format"]).schema(config["schema"]).options(**config.get("options", {})).load(config["path"])


def rate(spark: SparkSession, config: dict) -> DataFrame:
    return spark.readStream.format("rate").options(**config).load()


def status(configs: DataFrame, leases: DataFrame, now_us: int) -> DataFrame:
    """id, name, owner and active of configs (id, name) with the leases (key, holder, expires_us) of their ids.

    A lease that has run out, or none, leaves a connector without owner.
    """
    held = leases.where((F.col("expires_us") > now_us) & F.col("holder").isNotNull()).select(F.col("key").alias("id"), F.col("holder").alias("owner"))
    return configs.select("id", "name").join(held, "id", "left").withColumn("active", F.col("owner").isNotNull())
