"""Table access by name below a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table, with only ``columns`` if any are named."""
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    return found.select(*columns) if columns else found
