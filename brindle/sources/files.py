"""Files of records: JSON documents, delimited tables, JSON lines, N-Triples; and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_documents(spark: SparkSession, path: str, schema: str, exclude: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, skipped): one object a file; files that aren't objects of the schema come back with their path.

    Files whose name ends in one of ``exclude``, as a run's own outputs, are left out.
    """
    kinds = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", kinds, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    rows = rows.select("d.*", "path")
    for name in exclude:
        rows = rows.where(~F.col("path").endswith(name))
    return rows.where("_corrupt is null").drop("_corrupt"), rows.where("_corrupt is not null").select("path")


def csv_table(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """A delimited table of strings with a header; short rows are padded, empty cells are empty strings."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("emptyValue", "").csv(path)
    return rows.na.fill("")


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in the contract's order, every cell quoted."""
    rows.select(*columns).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def results_log(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated log of results, typed; what doesn't parse is null."""
    rows = csv_table(spark, path, ["iteration", "timestamp_utc", "status", "metric_value"], "\t")
    metric = F.expr("try_cast(metric_value as double)")
    sound = F.when(~F.isnan(metric) & (F.abs(metric) < float("inf")), metric)
    return rows.select(F.expr("try_cast(iteration as int)").alias("iteration"), F.try_to_timestamp("timestamp_utc").alias("ts"), F.lower(F.trim("status")).alias("status"), sound.alias("metric"))


def peak_usage(spark: SparkSession, path: str) -> DataFrame:
    """Largest resident size in a stream of JSON lines; broken lines are passed over."""
    rows = spark.read.schema("rss long, peak_rss long, pcpu double").json(path)
    return rows.agg(F.max(F.coalesce("peak_rss", "rss")).alias("peak_rss"), F.max("pcpu").alias("peak_pcpu"))


_TRIPLE = r"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|\"(?:[^\"\\]|\\.)*\"\S*)\s*\.\s*$"


def n_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of an N-Triples file; comments and broken lines are passed over, literals keep quotes and types."""
    lines = spark.read.text(path).where(F.col("value").rlike(_TRIPLE))
    part = lambda k: F.regexp_extract("value", _TRIPLE, k)
    bare = lambda c: F.regexp_replace(c, "^<(.*)>$", "$1")
    return lines.select(bare(part(1)).alias("s"), part(2).alias("p"), bare(part(3)).alias("o"))


def write_n_triples(triples: DataFrame, path: str) -> None:
    node = lambda c: F.when(F.col(c).rlike(r'^(_:|")'), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    triples.select(F.concat_ws(" ", node("s"), node("p"), node("o"), F.lit("."))).write.mode("overwrite").text(path)
