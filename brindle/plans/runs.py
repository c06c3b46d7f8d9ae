"""Logs of runs, tasks, cards and references made from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import runs as r
from brindle.sources.tables import read


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").selectExpr("user_id AS run", "event_id AS place", "unix_seconds(cast(ts AS timestamp)) AS at", "CASE WHEN user_id % 3 > 0 THEN unix_seconds(timestamp'2024-01-01 00:00:00') + user_id % 20 * 86400 END AS started", "event_type = 'error' AS failed")


_L = "l AS (SELECT user_id AS run, event_id AS place, floor(epoch(ts))::BIGINT AS moment, CASE WHEN user_id % 3 > 0 THEN epoch(TIMESTAMP '2024-01-01')::BIGINT + user_id % 20 * 86400 END AS started, event_type = 'error' AS failed FROM events), i AS (SELECT * FROM l WHERE started IS NULL OR moment >= started)"


def slice_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Failures in a row at the end of each run's slice."""
    return r.failures_in_slice(_log(spark, sf))


FAILURES = f"WITH {_L}, k AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY moment DESC, place DESC) AS ok FROM i) SELECT run, count(k.place) FILTER (ok = 0) AS failures FROM (SELECT DISTINCT run FROM l) LEFT JOIN k USING (run) GROUP BY 1"


def slice_pace(spark: SparkSession, sf: str) -> DataFrame:
    """Pace of each run's slice over its last five gaps, and the age of its last row."""
    return r.pace(_log(spark, sf), F.unix_seconds(F.to_timestamp(F.lit("2024-02-15 00:00:00"))))


PACE = f"""
WITH {_L}, p AS (SELECT run, moment, place FROM i UNION ALL SELECT DISTINCT run, started, -1 FROM l WHERE started IS NOT NULL), g AS (SELECT *, greatest(0, moment - lag(moment) OVER (PARTITION BY run ORDER BY moment, place)) AS gap, lag(moment) OVER (PARTITION BY run ORDER BY moment, place) IS NULL AS none, row_number() OVER (PARTITION BY run ORDER BY moment DESC, place DESC) AS k FROM p)
SELECT run, greatest(0, epoch(TIMESTAMP '2024-02-15')::BIGINT - max(moment)) AS last_age, floor(sum(gap) FILTER (k <= 5 AND NOT none) / count(gap) FILTER (k <= 5 AND NOT none))::BIGINT AS avg_gap FROM (SELECT DISTINCT run FROM l) LEFT JOIN g USING (run) GROUP BY 1
"""

_STATE = """SELECT c_custkey AS run, 1000 AS budget, 1000 - c_custkey % 30 * 40 AS remaining, c_custkey % 9 * 60 AS avg_gap, c_custkey % 13 * 100 AS last_age, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey * 1000 END AS peak_rss, c_custkey % 6 AS failures, c_custkey % 17 AS since, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS latest,
    CASE c_custkey % 3 WHEN 0 THEN 'higher' WHEN 1 THEN 'lower' ELSE '' END AS direction, CASE c_custkey % 19 WHEN 0 THEN ' Block' WHEN 1 THEN 'warn' WHEN 2 THEN 'allow' END AS decision, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 11 / 10e0 END AS trust, CASE WHEN c_custkey % 23 = 0 THEN true END AS drift FROM {customer}"""


def _signals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.sql(_STATE, customer=read(spark, sf, "customer"))
    return rows, r.signals(rows, 100, 0.8, 1000, 20000, 5, 15, 0.0, 0.1)


def run_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Every signal of every run."""
    return _signals(spark, sf)[1]


_G = f"""s AS ({_STATE.replace('{customer}', 'customer')}), g AS (SELECT run, unnest([CASE WHEN remaining <= 100 THEN 'budget/budget_exhausted/break' END, CASE WHEN remaining > 100 AND budget - remaining >= 800 THEN 'budget/budget_warning/warn' END, CASE WHEN avg_gap > 0 AND avg_gap > greatest(remaining - 100, 0) THEN 'engineering/pace_insufficient_budget/break' END,
  CASE WHEN last_age > 1000 THEN 'engineering/stalled/break' END, CASE WHEN peak_rss > 20000 THEN 'engineering/resource_rss/break' END, CASE WHEN failures >= 5 THEN 'correctness/repeated_failures/break' END, CASE WHEN direction <> '' AND since >= 15 THEN 'validity/no_improvement/break' END, CASE WHEN (direction = 'higher' AND latest < 0) OR (direction = 'lower' AND latest > 0) THEN 'validity/guardrail_violation/break' END,
  CASE WHEN drift THEN 'governance/drift_detected/break' END, CASE WHEN trust < 0.1 THEN 'governance/low_trust/break' END, CASE WHEN decision = ' Block' THEN 'governance/blocked/break' END, CASE WHEN decision = 'warn' THEN 'governance/governance_warning/warn' END]) AS x FROM s),
f AS (SELECT run, split_part(x, '/', 1) AS category, split_part(x, '/', 2) AS code, split_part(x, '/', 3) AS severity FROM g WHERE x IS NOT NULL)"""
SIGNALS = f"WITH {_G} SELECT * FROM f"


def run_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Break, warn or continue, and the category that decides."""
    return r.decisions(*_signals(spark, sf))


DECISIONS = f"""
WITH {_G}, d AS (SELECT run, min(CASE category WHEN 'governance' THEN 0 WHEN 'correctness' THEN 1 WHEN 'budget' THEN 2 WHEN 'engineering' THEN 3 ELSE 4 END) FILTER (severity = 'break') AS k, bool_or(severity = 'warn') AS w FROM f GROUP BY 1)
SELECT s.run, CASE WHEN k IS NOT NULL THEN 'break' WHEN w THEN 'warn' ELSE 'continue' END AS decision, (['governance', 'correctness', 'budget', 'engineering', 'validity'])[k + 1] AS category FROM s LEFT JOIN d ON d.run = s.run
"""


def budgeted_polls(spark: SparkSession, sf: str) -> DataFrame:
    """The poll that reads each item's details within the budget of its source, the oldest first."""
    return r.polls(read(spark, sf, "orders").selectExpr("o_custkey AS source", "o_orderkey AS item", "o_orderdate AS updated_at", "o_orderkey % 3 + 1 AS calls"), 5)


POLLS = "SELECT o_custkey AS source, o_orderkey AS item, floor((sum(o_orderkey % 3 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) - 1) / 5)::BIGINT AS poll FROM orders"


def next_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """The next task of each job."""
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    tasks = lines.selectExpr("l_orderkey AS job", "concat('t', l_linenumber) AS task", "l_linenumber AS place", "CASE flag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'waiting' ELSE CASE WHEN l_orderkey % 2 = 0 THEN 'rejected' ELSE 'claimed' END END AS state")
    needs = lines.where("l_linenumber > 2").selectExpr("l_orderkey AS job", "concat('t', l_linenumber) AS task", "concat('t', l_linenumber - 2) AS need").join(tasks.select("job", F.col("task").alias("need")), ["job", "need"], "left_semi")
    return r.next_tasks(tasks, needs)


TASKS = """
WITH t AS (SELECT l_orderkey AS job, l_linenumber AS k, CASE max(l_returnflag) WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'waiting' ELSE CASE WHEN l_orderkey % 2 = 0 THEN 'rejected' ELSE 'claimed' END END AS state FROM lineitem GROUP BY 1, 2)
SELECT job, 't' || min(k) AS task FROM t WHERE state IN ('waiting', 'rejected') AND NOT EXISTS (SELECT 1 FROM t n WHERE n.job = t.job AND n.k = t.k - 2 AND n.state <> 'accepted') GROUP BY 1
"""


def compute_used(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds of each run and its best row by direction."""
    return r.compute_used(read(spark, sf, "orders").selectExpr("o_custkey AS run", "o_orderkey AS row", "o_orderkey % 60 AS seconds", "CASE WHEN o_orderkey % 7 > 0 THEN round(o_totalprice, 0) ELSE double('nan') END AS metric", "CASE WHEN o_custkey % 2 = 0 THEN 'higher' ELSE 'lower' END AS direction"))


COMPUTE = "SELECT o_custkey AS run, sum(o_orderkey % 60)::BIGINT AS seconds, CASE WHEN o_custkey % 2 = 0 THEN max(round(o_totalprice, 0)) FILTER (o_orderkey % 7 > 0) ELSE min(round(o_totalprice, 0)) FILTER (o_orderkey % 7 > 0) END AS best, first(o_orderkey ORDER BY CASE WHEN o_custkey % 2 = 0 THEN -round(o_totalprice, 0) ELSE round(o_totalprice, 0) END, o_orderkey) FILTER (o_orderkey % 7 > 0) AS best_row FROM orders GROUP BY o_custkey"


def entity_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Cards of entities with assays, marker sets and panels."""
    lines, parts = read(spark, sf, "lineitem"), read(spark, sf, "part")
    edges = lines.selectExpr("l_partkey AS e", "l_suppkey AS assay", "l_orderkey AS node").distinct()
    return r.cards(edges, parts.selectExpr("p_partkey AS e", "p_name AS label"), read(spark, sf, "supplier").where("s_suppkey % 4 > 0").selectExpr("s_suppkey AS assay", "s_name AS kind"), read(spark, sf, "orders").where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS node", "o_orderpriority AS markers"), read(spark, sf, "supplier").where("s_suppkey % 3 = 0").selectExpr("s_suppkey AS assay", "concat('panel ', s_nationkey) AS panel"))


CARDS = "SELECT DISTINCT l_partkey AS e, p_name AS label, l_suppkey AS assay, s_name AS kind, l_orderkey AS node, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'NA' END AS markers, CASE WHEN s_suppkey % 3 = 0 THEN 'panel ' || s_nationkey ELSE 'NA' END AS panel FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 4 > 0 LEFT JOIN orders ON o_orderkey = l_orderkey"


def variable_uses(spark: SparkSession, sf: str) -> DataFrame:
    """Variables that uses in models name, by wording, else by measure, settled by the stated role."""
    variables = read(spark, sf, "supplier").selectExpr("s_suppkey AS variable", "concat('w', s_suppkey % 7) AS wording", "concat('m', s_nationkey % 5) AS measure", "concat('r', s_suppkey % 3) AS role")
    uses = read(spark, sf, "customer").selectExpr("c_custkey AS use", "CASE WHEN c_custkey % 2 = 0 THEN concat('w', c_custkey % 9) ELSE concat('m', c_custkey % 6) END AS name", "concat('r', c_nationkey % 3) AS role")
    return r.roles_of_variables(uses, variables)


USES = """
WITH u AS (SELECT c_custkey AS use, CASE WHEN c_custkey % 2 = 0 THEN 'w' || c_custkey % 9 ELSE 'm' || c_custkey % 6 END AS name, c_nationkey % 3 AS role FROM customer), v AS (SELECT s_suppkey AS variable, ['w' || s_suppkey % 7, 'm' || s_nationkey % 5] AS names, s_suppkey % 3 AS own FROM supplier),
x AS (SELECT use, count(DISTINCT variable) AS n, min(variable) AS v, count(DISTINCT variable) FILTER (own = role) AS m, min(variable) FILTER (own = role) AS w FROM u JOIN v ON list_contains(names, name) GROUP BY 1) SELECT u.use, CASE WHEN n = 1 THEN v WHEN m = 1 THEN w END AS variable FROM u LEFT JOIN x USING (use)
"""


def rendered_references(spark: SparkSession, sf: str) -> DataFrame:
    """references in four styles, and parts of strings before and after marks."""
    rows = read(spark, sf, "part").selectExpr("p_partkey", "concat(p_brand, ', A') AS authors", "CASE WHEN p_size % 3 > 0 THEN 1990 + p_size END AS year", "p_name AS title", "CASE WHEN p_size % 4 > 0 THEN p_type END AS journal", "CASE WHEN p_size % 2 = 0 THEN concat('10.5/', p_partkey) END AS doi")
    styles = [r.reference(s, *[F.col(c) for c in ("authors", "year", "title", "journal", "doi")]).alias(s) for s in ("apa", "nature", "vancouver", "ieee")]
    return rows.select("p_partkey", *styles, r.after(F.col("authors"), "#").alias("after"), r.before(F.col("title"), " r").alias("before"))


REFERENCES = """
WITH p AS (SELECT p_partkey, p_brand || ', A' AS a, CASE WHEN p_size % 3 > 0 THEN 1990 + p_size END AS y, p_name AS t, CASE WHEN p_size % 4 > 0 THEN p_type END AS j, CASE WHEN p_size % 2 = 0 THEN ' https://doi.org/10.5/' || p_partkey ELSE '' END AS l FROM part)
SELECT p_partkey, a || coalesce(' (' || y || ').', '') || ' ' || t || '.' || coalesce(' ' || j || '.', '') || l AS apa, a || ' ' || t || '.' || coalesce(' ' || j, '') || coalesce(' (' || y || ').', '') || l AS nature, a || '. ' || t || '.' || coalesce(' ' || j || '.', '') || coalesce(' ' || y || '.', '') || l AS vancouver,
  a || ', "' || t || ',"' || coalesce(' ' || j || ',', '') || coalesce(' ' || y || '.', '') || l AS ieee, split_part(a, '#', 2) AS after, CASE WHEN t LIKE '% r%' THEN split_part(t, ' r', 1) ELSE '' END AS before FROM p
"""


def caption_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Captions of texts, and what they refer to."""
    text = "concat('As Fig. 1 and figure 1 show, table ', p_size % 3, ' too.\\nFigure 1. One\\n', CASE WHEN p_size % 2 = 0 THEN 'Fig. 2 Two\\n' ELSE '' END, 'Table 1: T')"
    return read(spark, sf, "part").selectExpr("p_partkey", f"{text} AS text").select("p_partkey", r.captions(F.col("text")).alias("c")).select("p_partkey", "c.*")


CAPTIONS = "SELECT p_partkey, 1 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS figures, 1 AS tables, 1 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + 1 + CASE WHEN p_size % 3 = 1 THEN 0 ELSE 1 END AS cited FROM part"


def all_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of several lists in one, and articles with their texts."""
    return r.of_kinds({"part": read(spark, sf, "part").selectExpr("p_partkey AS id", "p_name AS name"), "customer": read(spark, sf, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS segment"), "article": read(spark, sf, "documents", "doc_id", "n_chars").join(read(spark, sf, "labels"), "doc_id").selectExpr("doc_id AS id", "n_chars")})


KINDS = "SELECT p_partkey AS id, p_name AS name, 'part' AS kind, NULL AS segment, NULL::BIGINT AS n_chars FROM part UNION ALL SELECT c_custkey, NULL, 'customer', c_mktsegment, NULL FROM customer UNION ALL SELECT d.doc_id, NULL, 'article', NULL, n_chars FROM documents d JOIN labels USING (doc_id)"


def query_report(spark: SparkSession, sf: str) -> DataFrame:
    """The status of prepared queries, parameters bound by name."""
    orders = read(spark, sf, "orders")
    ask = lambda **args: spark.sql("SELECT * FROM {o} WHERE o_orderstatus = :status", args=args, o=orders)
    bad = orders.select(F.raise_error(F.lit("broken")).cast("int").alias("x"))
    report = r.catalogue({"finished": (ask(status="F"), ""), "none": (ask(status="?"), ""), "injected": (ask(status="F' OR '1'='1"), ""), "missing": (None, ""), "broken": (bad.where("x > 0"), "")})
    return spark.createDataFrame(report, "name string, status string, rows long")


REPORT = "SELECT 'finished' AS name, 'answered' AS status, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS rows UNION ALL SELECT 'none', 'empty', 0 UNION ALL SELECT 'injected', 'empty', 0 UNION ALL SELECT 'missing', 'unavailable', 0 UNION ALL SELECT 'broken', 'error', 0"

QUERIES = {
    "slice_failures": (slice_failures, FAILURES),
    "slice_pace": (slice_pace, PACE),
    "run_signals": (run_signals, SIGNALS),
    "run_decisions": (run_decisions, DECISIONS),
    "budgeted_polls": (budgeted_polls, POLLS),
    "next_tasks": (next_tasks, TASKS),
    "compute_used": (compute_used, COMPUTE),
    "entity_cards": (entity_cards, CARDS),
    "variable_uses": (variable_uses, USES),
    "rendered_references": (rendered_references, REFERENCES),
    "caption_counts": (caption_counts, CAPTIONS),
    "all_kinds": (all_kinds, KINDS),
    "query_report": (query_report, REPORT),
}
