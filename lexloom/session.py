"""Session settings for this library's plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the warehouse; filters and columns are pushed into its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
