"""The whole synthesis over papers: constructs, variables, the links between them, and totals, from one table of facts.

A fact is (kind, paper, construct, variable, role, direction):

* ``declared``: a paper uses a variable, in a role or ``unspecified``; ``model``: one of its models gives it a role;
* ``study``: a paper names a construct; ``measure``: it says that a variable measures it;
* ``finding``: it finds something of a construct, in a direction; ``involves``: a variable is part of that, in a role.

Levels are grouping sets of one pass: facts are expanded once, reduced to one row a paper at each level, and counted. The
counting unit is the paper, so that one with many models does not outweigh others. Verdicts are those of consensus and of
variable_roles. Null constructs and variables make no row at their level; repeated facts count once as papers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import roles
from brindle.sources.shared import written

#: Kinds that make a paper one of a construct, and roles that a finding gives.
OF_CONSTRUCT = ["study", "measure", "finding", "involves"]
FOUND_ROLES = ["mediator", "moderator"]


def levels(facts: DataFrame) -> DataFrame:
    """(level, construct, variable, papers, declared, measured, involved, uses, findings) of all, construct, variable and link."""
    of_variable = F.col("variable").isNotNull()
    of_construct = F.col("construct").isNotNull() & F.col("kind").isin(*OF_CONSTRUCT)
    sets = [["construct", "paper"], ["variable", "paper"], ["construct", "variable", "paper"], ["paper"]]
    is_kind = lambda kind: F.col("kind") == kind
    known = facts.select("kind", "paper", F.when(of_construct, F.col("construct")).alias("construct"), F.when(of_variable, F.col("variable")).alias("variable"))
    by_paper = known.groupingSets(sets, "construct", "variable", "paper").agg(
        F.grouping_id().alias("_set"), F.bool_or(is_kind("declared")).alias("declared"), F.bool_or(is_kind("measure")).alias("measured"), F.bool_or(is_kind("involves")).alias("involved"), F.count_if(is_kind("declared")).alias("uses"), F.count_if(is_kind("finding")).alias("findings")
    )
    level = F.when(F.col("_set") == 6, "all").when(F.col("_set") == 2, "construct").when(F.col("_set") == 4, "variable").otherwise("link")
    rows = by_paper.withColumn("level", level).where("level = 'all' or (level = 'construct' and construct is not null) or (level = 'variable' and variable is not null) or (level = 'link' and construct is not null and variable is not null)")
    return rows.groupBy("level", "construct", "variable").agg(F.count(F.lit(1)).alias("papers"), *[F.count_if(c).alias(c) for c in ("declared", "measured", "involved")], F.sum("uses").alias("uses"), F.sum("findings").alias("findings"))


def synthesis(facts: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, totals): the levels' rows with verdicts, and one row of totals; tables: (variable, table) of the mapped ones."""
    facts = written(facts, "facts")
    found = facts.where(F.col("kind").isin(*OF_CONSTRUCT) & F.col("construct").isNotNull())
    directions = found.select("construct", "paper", F.when(F.col("kind") == "finding", F.coalesce("direction", F.lit("unspecified"))).alias("direction"))
    constructs = roles.consensus(directions).select(F.lit("construct").alias("level"), "construct", F.lit(None).cast(facts.schema["variable"].dataType).alias("variable"), "agreement", "verdict")
    used = facts.where(F.col("variable").isNotNull())
    role = F.when(F.col("kind").isin("declared", "model"), F.coalesce("role", F.lit("unspecified"))).when(F.col("role").isin(*FOUND_ROLES), F.col("role")).otherwise("unspecified")
    variables = roles.variable_roles(used.select("variable", "paper", role.alias("role")))
    named = variables.select(F.lit("variable").alias("level"), F.lit(None).cast(facts.schema["construct"].dataType).alias("construct"), "variable", F.col("share").alias("agreement"), "verdict", "dominant_role")
    verdicts = constructs.withColumn("dominant_role", F.lit(None).cast("string")).unionByName(named)
    verdicts = verdicts.select(F.col("level").alias("_l"), F.col("construct").alias("_c"), F.col("variable").alias("_v"), "agreement", "verdict", "dominant_role")
    counted = levels(facts)
    rows = counted.join(verdicts, F.col("level").eqNullSafe(F.col("_l")) & F.col("construct").eqNullSafe(F.col("_c")) & F.col("variable").eqNullSafe(F.col("_v")), "left").drop("_l", "_c", "_v")
    rows = rows.join(tables.groupBy(F.col("variable").alias("_v")).agg(F.min("table").alias("table")), (F.col("level") == "variable") & (F.col("variable") == F.col("_v")), "left").drop("_v")
    rows = written(rows, "synthesis")
    at = lambda level, test: F.count_if((F.col("level") == level) & test)
    whole = lambda c: F.coalesce(F.max(F.when(F.col("level") == "all", F.col(c))), F.lit(0))
    consistent = lambda r: at("variable", (F.col("verdict") == "consistent_role") & (F.col("dominant_role") == r))
    totals = rows.agg(
        whole("papers").alias("papers"), whole("uses").alias("variable_uses"), whole("findings").alias("findings"), at("variable", F.lit(True)).alias("distinct_variables"), at("construct", F.lit(True)).alias("distinct_constructs"), at("link", F.lit(True)).alias("links"),
        at("variable", F.col("table").isNotNull()).alias("variables_with_table"), at("construct", F.col("verdict") == "consensus").alias("consensus_constructs"), at("construct", F.col("verdict") == "divergent").alias("divergent_constructs"),
        consistent("mediator").alias("consistent_mediators"), consistent("moderator").alias("consistent_moderators"), at("variable", F.col("verdict") == "contested_role").alias("contested_roles"),
    )
    return rows, totals
