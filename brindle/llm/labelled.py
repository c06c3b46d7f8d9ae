"""Bounded, reproducible samples of labelled documents.

Defined cases: null ids and labels other than 0 and 1 don't count; an id labelled twice takes its larger label; rows of
one id are taken together or not at all; without labels, or without documents, the sample is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.storage import cut

#: Bytes of text that a class adds to a sample at most.
CLASS_BYTES = 16 << 20
#: Ids with more bytes than this share of CLASS_BYTES are not learnt from.
LONGEST = 1 / 4


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % modulus


def known(labels: DataFrame, label: str, train: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, label 0 or 1) of the labels that may be learnt from; an id labelled twice takes its larger label."""
    found = labels.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{label}`").cast("int").alias("label"))
    found = found.where(F.col(id_col).isNotNull() & F.col("label").isin(0, 1) & train)
    return found.groupBy(id_col).agg(F.max("label").alias("label"))


def shares(known: DataFrame) -> tuple[float, float]:
    """Shares of the classes 0 and 1 among all known labels, one of each added."""
    n, ones = known.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    return (n - ones + 1) / (n + 2), (ones + 1) / (n + 2)


def sample(docs: DataFrame, known: DataFrame, per_class: int, id_col: str = "doc_id", text_col: str = "text", classes: int = 2, class_bytes: int = CLASS_BYTES) -> DataFrame:
    """(id, text, label): whole texts of at most ``per_class`` known ids and ``class_bytes`` of text a class, least hash first.

    The ids, at most ``per_class`` for each class, are broadcast.
    """
    order = F.xxhash64(id_col)
    chosen = [known.where(F.col("label") == k).orderBy(order, id_col).limit(per_class) for k in range(classes)]
    ids = reduce(DataFrame.unionByName, chosen).select(F.col(id_col).alias("_id"), "label")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found = cut(texts.join(F.broadcast(ids), F.col("id") == F.col("_id")).select("id", "text", "label"), "sample")
    # Of ids, of which there are few, those within the bound of bytes; a row takes a byte more than its text.
    sizes = found.groupBy("id", "label").agg(F.sum(F.octet_length("text") + 1).alias("size")).where(F.col("size") <= class_bytes * LONGEST)
    so_far = F.sum("size").over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    within = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= class_bytes).select("id")
    return found.join(F.broadcast(within), "id", "left_semi")
