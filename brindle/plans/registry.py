"""Every registered query with its SQL oracle, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.plans import cluster, corpus, entity_graph, events, evidence, formats, graph, matching, mentions, records, relational, resource_graph, runs, streams, texts, values, work

#: Modules with ``QUERIES``: name -> (function of (spark, sf_dir), oracle SQL or None).
MODULES: list = [corpus, relational, events, graph, texts, streams, entity_graph, resource_graph, cluster, work, mentions, matching, evidence, values, records, formats, runs]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, (f, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
