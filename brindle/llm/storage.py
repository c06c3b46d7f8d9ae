"""Where intermediate tables live, and how lineage is cut.

Every table an operator writes goes below the folder the cluster names in ``spark.checkpoint.dir``:
executors and driver share it, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. In local mode, where all share one disk, one is made if none is set; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/brindle/{name}-{uuid.uuid4().hex}"


#: Paths of the tables written inside each open :func:`intermediates`, innermost last.
_OPEN: list[list[str]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`cut` writes inside are deleted at the end; what is to last is written before or after."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _delete(spark, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`cut`, but the table outlives the :func:`intermediates` it is written in."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing will read again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/brindle/" in folder:
                _delete(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner free shuffle files of jobs whose results have been cut."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Exactly ``columns``, untouched by whatever else the table carries."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
