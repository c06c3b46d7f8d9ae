"""Weighted verdicts, consensus over papers, role exclusivity, and the fold of an operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import entities


def weighted_scores(rows: DataFrame, key: list[str], unit: int = 1) -> DataFrame:
    """Sum of weight x confidence x score over sum of weight; a critical fail drops the item.

    rows: verdict (pass, flag, fail), weight, confidence in parts of ``unit``, critical. A pass scores 1, a flag half
    as much; with whole weights and confidences sums are exact, in any order.
    """
    score = F.when(F.col("verdict") == "pass", 2).when(F.col("verdict") == "flag", 1).otherwise(0)
    weighted = F.sum(F.col("weight") * F.col("confidence") * score)
    gate = F.coalesce(F.bool_or(F.col("critical") & (F.col("verdict") == "fail")), F.lit(False))
    return rows.groupBy(*key).agg(F.round(F.try_divide(weighted, F.sum("weight") * F.lit(2.0 * unit)), 4).alias("score"), F.count(F.lit(1)).alias("reviews"), gate.alias("dropped"))


def consensus(claims: DataFrame) -> DataFrame:
    """Verdict on each construct from distinct (paper, direction) claims, directions positive, negative or null."""
    said = lambda d: F.max(F.when(F.col("direction") == d, 1).otherwise(0)).cast("long")
    by_paper = claims.groupBy("construct", "paper").agg(*[said(d).alias(name) for d, name in (("positive", "positive"), ("negative", "negative"), ("null", "neutral"))])
    counts = by_paper.groupBy("construct").agg(F.count(F.lit(1)).alias("papers"), *[F.sum(c).alias(c) for c in ("positive", "negative", "neutral")])
    share = F.greatest("positive", "negative", "neutral") / (F.col("positive") + F.col("negative") + F.col("neutral"))
    verdict = F.when(F.col("papers") < 2, "insufficient_papers").when((F.col("positive") > 0) & (F.col("negative") > 0), "divergent").when(share >= 0.7, "consensus").otherwise("mixed")
    return counts.withColumn("agreement", F.round(share, 3)).withColumn("verdict", verdict)


def role_exclusivity(uses: DataFrame) -> DataFrame:
    """Dominant role of each variable by papers, and the share of papers where it is the only one."""
    once = uses.select("variable", "paper", "role").distinct()
    papers = once.groupBy("variable", "paper").agg(F.count(F.lit(1)).alias("roles"))
    by_role = once.join(papers, ["variable", "paper"]).groupBy("variable", "role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("roles") == 1).alias("alone"))
    totals = papers.groupBy("variable").agg(F.count(F.lit(1)).alias("papers"))
    top = entities.best_per_key(by_role, ["variable"], F.desc("n"), F.asc("role")).join(totals, "variable")
    share = F.col("n") / F.col("papers")
    verdict = F.when(F.col("papers") < 2, "insufficient").when(F.col("alone") == F.col("papers"), "consistent").when(share >= 0.7, "contested").otherwise("mixed")
    return top.select("variable", F.col("role").alias("dominant_role"), "papers", F.round(share, 3).alias("dominant_share"), F.round(F.col("alone") / F.col("papers"), 3).alias("exclusivity"), verdict.alias("verdict"))


def oplog(ops: DataFrame) -> DataFrame:
    """State of each id after its operations: last value set, and whether the last drop came after any restore."""
    last = lambda op: F.max(F.when(F.col("op") == op, F.col("at")))
    folded = ops.groupBy("id").agg(F.count(F.lit(1)).alias("ops"), F.max_by(F.when(F.col("op") == "set", F.col("value")), F.when(F.col("op") == "set", F.col("at"))).alias("value"), last("drop").alias("_drop"), last("restore").alias("_restore"))
    dropped = F.col("_drop").isNotNull() & (F.col("_restore").isNull() | (F.col("_drop") > F.col("_restore")))
    return folded.select("id", "ops", "value", dropped.alias("dropped"))
