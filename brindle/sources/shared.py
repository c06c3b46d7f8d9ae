"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What the session names in ``spark.checkpoint.dir``; in local mode one is made if none is set, a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written below the shared folder and read again: made once, and read again if an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/brindle/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` where its scan has fewer partitions than there are cores; else as it is, unshuffled."""
    return df if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` for costly work on each row, however few groups its file has: three tasks a core at least.

    The number is named, so that adaptive execution does not put parts together by their size, which tells nothing of the work.
    """
    session = df.sparkSession
    n = max(3 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def tasks(df: DataFrame, work: int | None, most: int) -> int:
    """How many tasks to deal counted ``work`` out to, so that each has about ``most`` of it however large it is: one a core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-(work or 0) // most))


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that are shuffled, whatever its size is taken for.

    Else tables that grow with the input are sent through the driver while their files are small, which tells little of rows
    that compress well or that are made many of.
    """
    return df.hint("merge")
