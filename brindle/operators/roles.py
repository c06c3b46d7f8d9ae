"""Synthesis over papers: consensus on constructs, roles of variables, claims and their sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of claims, or of papers, from which they count as agreeing; papers that a verdict needs.
THRESHOLD = 0.7
PAPERS = 2


def consensus(rows: DataFrame) -> DataFrame:
    """Verdict on each construct of (construct, paper, direction); a null direction only studies it.

    Agreement is the majority's share of distinct paper-direction claims among positive, negative and null ones.
    """
    once = rows.select("construct", "paper", "direction").distinct()
    sides = [F.count_if(F.col("direction") == d).alias(n) for d, n in (("positive", "positive"), ("negative", "negative"), ("null", "neutral"))]
    by_paper = once.groupBy("construct", "paper").agg(*sides, F.count("direction").alias("any"))
    counts = by_paper.groupBy("construct").agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.col("any") > 0).alias("directed"), *[F.sum(c).alias(c) for c in ("positive", "negative", "neutral")])
    share = F.coalesce(F.try_divide(F.greatest("positive", "negative", "neutral"), F.col("positive") + F.col("negative") + F.col("neutral")), F.lit(0.0))
    verdict = (
        F.when(F.col("directed") == 0, "no_directional_finding")
        .when(F.col("directed") < PAPERS, "insufficient_papers")
        .when((F.col("positive") > 0) & (F.col("negative") > 0), "divergent")
        .when(share >= THRESHOLD, "consensus")
        .otherwise("mixed")
    )
    return counts.withColumn("agreement", F.bround(share, 3)).withColumn("verdict", verdict)


def variable_roles(uses: DataFrame) -> DataFrame:
    """Dominant role of each variable over (variable, paper, role), its share, and the share of papers where it is the only one."""
    once = uses.select("variable", "paper", "role").distinct()
    totals = once.groupBy("variable").agg(F.count_distinct("paper").alias("papers"))
    real = once.where("role != 'unspecified'")
    alone = real.groupBy("variable", "paper").agg(F.count(F.lit(1)).alias("roles"))
    by_role = real.join(alone, ["variable", "paper"]).groupBy("variable", "role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("roles") == 1).alias("alone"))
    # The most papers, then the first name: the least of (-n, role).
    top = by_role.groupBy("variable").agg(F.count(F.lit(1)).alias("claimed"), F.min(F.struct((-F.col("n")).alias("least"), "role", "alone")).alias("x"))
    found = totals.join(top, "variable", "left")
    share, own = F.coalesce(-F.col("x.least"), F.lit(0)) / F.col("papers"), F.coalesce("x.alone", F.lit(0)) / F.col("papers")
    verdict = (
        F.when(F.col("papers") < PAPERS, "insufficient_papers")
        .when((share >= THRESHOLD) & (own >= THRESHOLD), "consistent_role")
        .when(F.col("claimed") > 1, "contested_role")
        .when(F.col("x.role").isNotNull(), "mixed")
        .otherwise("unspecified_role")
    )
    return found.select("variable", "papers", F.col("x.role").alias("dominant_role"), F.bround(share, 3).alias("share"), F.bround(own, 3).alias("exclusivity"), verdict.alias("verdict"))


def matrix(uses: DataFrame, models: list[str]) -> DataFrame:
    """One row a variable, one column a model: its roles there, in order, joined by a slash; empty without one."""
    held = uses.groupBy("variable").pivot("model", models).agg(F.array_join(F.array_sort(F.collect_set("role")), "/"))
    return held.na.fill("", models)


def claims(rows: DataFrame) -> DataFrame:
    """Papers for and against each claim of (claim, paper, supports, caveat), and its caveats in order."""
    side = lambda yes: F.count_distinct(F.when(F.col("supports") == yes, F.col("paper")))
    return rows.groupBy("claim").agg(side(True).alias("supporting"), side(False).alias("contradicting"), F.array_join(F.array_sort(F.collect_set("caveat")), "; ").alias("caveats"))
