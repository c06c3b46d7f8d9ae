"""Entity grouping: index, canonical surfaces, best mappings, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cross_document_index(mentions: DataFrame, key: list[str], doc: str) -> DataFrame:
    """Mentions and distinct documents of each key, by documents first, so that no set of documents is gathered."""
    by_doc = mentions.groupBy(*key, doc).agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy(*key).agg(F.sum("n").alias("mention_count"), F.count(F.lit(1)).alias("document_count"))


def best_per_key(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """First row of each key in the order; ranks are cut before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def canonical_surface(rows: DataFrame, key: list[str], surface: str) -> DataFrame:
    """Most common surface of each key, the longest, then the smallest, among equals: (key, surface, uses)."""
    uses = rows.groupBy(*key, surface).agg(F.count(F.lit(1)).alias("uses"))
    return best_per_key(uses, key, F.desc("uses"), F.desc(F.length(surface)), F.asc(surface))


def numbered(rows: DataFrame, key: list[str], name: Column, *order: Column, mark: str = " #") -> DataFrame:
    """``rows`` with ``document_id``: the name, with its number among equal names from the second on."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", n).withColumn("document_id", F.when(F.col("_n") > 1, F.concat(name, F.lit(mark), F.col("_n").cast("string"))).otherwise(name)).drop("_n")


def top_with_other(counts: DataFrame, label: str, n: str, k: int, other: str = "Other") -> DataFrame:
    """The k most frequent labels, and the sum of all others in one row."""
    top = counts.orderBy(F.desc(n), F.asc(label)).limit(k)
    rest = counts.join(F.broadcast(top.select(label)), label, "left_anti")  # k rows
    return top.unionByName(rest.agg(F.sum(n).alias(n)).where(F.col(n).isNotNull()).select(F.lit(other).alias(label), n))
