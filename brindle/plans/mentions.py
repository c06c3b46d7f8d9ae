"""Mentions, verdicts and logs made from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import mentions as m, synthesis
from brindle.operators import roles
from brindle.sources.tables import read


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS position", "l_suppkey AS doc",
        "CASE l_linenumber % 4 WHEN 0 THEN concat('Fast-\\nspiking cell ', l_partkey) WHEN 1 THEN concat('fast-spiking  cell ', l_partkey) WHEN 2 THEN concat('FAST-spiking cell ', l_partkey) ELSE concat('neu-\\nron ', l_partkey) END AS entity",
        "concat(' ', l_returnflag) AS label", "CASE WHEN l_linestatus = 'O' THEN 'r1' END AS referent", "CASE WHEN l_discount < 0.09 THEN l_discount * 0.8317e0 END AS judge_score", "CASE WHEN l_linenumber < 6 THEN concat('m', l_linenumber % 3) END AS source_model",
        "CASE WHEN l_suppkey % 3 > 0 THEN concat('ID:', l_suppkey % 4) ELSE '' END AS ontology_id", "CASE WHEN l_suppkey % 5 > 0 THEN 'x' ELSE 'None' END AS ontology_label", "CASE l_suppkey % 4 WHEN 0 THEN 'llm_knowledge' WHEN 1 THEN 'tool' END AS concept_mapping_provenance",
        "CASE WHEN l_linenumber > 1 THEN concat('s', l_orderkey % 3) END AS sentence", "CASE WHEN l_linenumber > 2 THEN concat('p', l_suppkey % 2) END AS paper_location", "CASE WHEN l_linenumber > 1 THEN l_orderkey END AS start", "CASE l_partkey % 3 WHEN 0 THEN 'vague' WHEN 1 THEN concat('h', l_linenumber % 2) END AS specificity",
    )


_M = """m AS (SELECT l_orderkey * 8 + l_linenumber AS position, l_suppkey AS doc, CASE l_linenumber % 4 WHEN 0 THEN 'Fast-spiking cell ' || l_partkey WHEN 1 THEN 'fast-spiking cell ' || l_partkey WHEN 2 THEN 'FAST-spiking cell ' || l_partkey ELSE 'neuron ' || l_partkey END AS reading,
  l_returnflag AS label, CASE WHEN l_linestatus = 'O' THEN 'r1' ELSE '' END AS referent, CASE WHEN l_discount < 0.09 THEN l_discount * 0.8317e0 END AS judge_score, CASE WHEN l_linenumber < 6 THEN 'm' || l_linenumber % 3 END AS source_model, CASE WHEN l_suppkey % 3 > 0 THEN 'ID:' || l_suppkey % 4 ELSE '' END AS ontology_id,
  CASE WHEN l_suppkey % 5 > 0 THEN 'x' ELSE 'None' END AS ontology_label, CASE l_suppkey % 4 WHEN 0 THEN 'llm_knowledge' WHEN 1 THEN 'tool' END AS provenance, CASE WHEN l_linenumber > 1 THEN 's' || l_orderkey % 3 END AS sentence, CASE WHEN l_linenumber > 2 THEN 'p' || l_suppkey % 2 END AS loc,
  CASE WHEN l_linenumber > 1 THEN l_orderkey END AS start, CASE l_partkey % 3 WHEN 0 THEN 'vague' WHEN 1 THEN 'h' || l_linenumber % 2 END AS specificity, l_orderkey, l_linenumber FROM lineitem), k AS (SELECT *, lower(reading) AS form FROM m),
u AS (SELECT form, label, referent, reading AS surface FROM (SELECT form, label, referent, reading, row_number() OVER (PARTITION BY form, label, referent ORDER BY count(*) DESC, length(reading) DESC, min(position)) AS r FROM k GROUP BY 1, 2, 3, 4) WHERE r = 1)"""


def mention_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of several models, none dropped, grouped by reading form, label and referent."""
    return m.groups(m.keyed(_mentions(spark, sf)))


GROUPS = f"""
WITH {_M} SELECT form, label, referent, count(*) AS mention_count, count(DISTINCT source_model) AS consensus_count, round_even(max(judge_score), 3) AS judge_score_max, round_even(avg(judge_score), 3) AS judge_score_avg, round_even(min(judge_score), 3) AS judge_score_min,
  arg_max(ontology_id, (coalesce(judge_score, 0), -position)) FILTER (ontology_id <> '') AS ontology_id, count(DISTINCT sentence) AS sentences, coalesce(string_agg(DISTINCT source_model, ',' ORDER BY source_model), '') AS source_models, any_value(surface) AS surface FROM k JOIN u USING (form, label, referent) GROUP BY 1, 2, 3
"""


def mention_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """A1: sentences of each group with their places in order of first use."""
    return m.sentence_locations(m.keyed(_mentions(spark, sf)))


SENTENCES = f"""
WITH {_M} SELECT form, label, referent, sentence, coalesce(string_agg(loc, ',' ORDER BY first, loc), '') AS locations FROM (SELECT form, label, referent, sentence, loc, min(position) AS first FROM k WHERE sentence IS NOT NULL GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4
"""


def unified_mappings(spark: SparkSession, sf: str) -> DataFrame:
    """A3, A4: every mention with the best mapping of its group."""
    found = m.unified(m.keyed(_mentions(spark, sf)), ["ontology_id", "ontology_label", "concept_mapping_provenance"])
    return found.select("position", "form", "ontology_id", "ontology_label", "concept_mapping_provenance")


_QUALITY = "CASE provenance WHEN 'tool' THEN 100 WHEN 'llm_knowledge' THEN 25 ELSE 0 END + CASE WHEN ontology_id <> '' THEN 50 ELSE 0 END + CASE WHEN ontology_label = 'x' THEN 10 ELSE 0 END"
UNIFIED = f"""
WITH {_M}, b AS (SELECT form, label, referent, ontology_id, ontology_label, provenance FROM (SELECT *, row_number() OVER (PARTITION BY form, label, referent ORDER BY {_QUALITY} DESC, position) AS r FROM k) WHERE r = 1)
SELECT position, k.form, b.ontology_id, b.ontology_label, b.provenance AS concept_mapping_provenance FROM k JOIN b USING (form, label, referent)
"""


def corpus_form_index(spark: SparkSession, sf: str) -> DataFrame:
    """A5: forms over documents, with the ids they were given and whether these differ."""
    return m.corpus_index(m.keyed(_mentions(spark, sf)))


INDEX = f"""
WITH {_M}, i AS (SELECT *, CASE WHEN coalesce(provenance, '') <> 'llm_knowledge' AND ontology_id <> '' THEN ontology_id END AS own FROM k),
v AS (SELECT form, label, reading AS surface FROM (SELECT form, label, reading, row_number() OVER (PARTITION BY form, label ORDER BY count(*) DESC, length(reading) DESC, min(position)) AS r FROM k GROUP BY 1, 2, 3) WHERE r = 1)
SELECT form, label, any_value(surface) AS surface, count(*) AS mention_count, count(DISTINCT doc) AS document_count, coalesce(string_agg(DISTINCT own, ',' ORDER BY own), '') AS ontology_ids, count(DISTINCT own) > 1 AS ontology_conflict, CASE WHEN count(DISTINCT specificity) = 1 THEN max(specificity) END AS specificity FROM i JOIN v USING (form, label) GROUP BY 1, 2
"""


def corpus_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of the corpus, recomputed from its mentions."""
    return m.corpus_totals(m.keyed(_mentions(spark, sf)))


TOTALS = f"""
WITH {_M} SELECT count(DISTINCT doc) AS documents, count(*) AS mentions, count(DISTINCT (form, label)) AS forms, count(*) FILTER (coalesce(provenance, '') <> 'llm_knowledge' AND ontology_id <> '') AS mapped, count(*) FILTER (NOT (coalesce(provenance, '') <> 'llm_knowledge' AND ontology_id <> '')) AS unmapped, round_even(count(*) / count(DISTINCT (form, label)), 2) AS mentions_a_form FROM k
"""


def ordered_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups with their ids and where they first stand."""
    return m.in_order(m.keyed(_mentions(spark, sf)))


ORDERED = f"WITH {_M} SELECT form, label, referent, any_value(surface) || '|' || label || CASE WHEN referent <> '' THEN '|referent=' || referent ELSE '' END AS id, min(coalesce(start, 1000000000000)) AS first FROM k JOIN u USING (form, label, referent) GROUP BY 1, 2, 3"


def grounding_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Groups whose mentions all anchor, none stand anywhere, or neither."""
    items = read(spark, sf, "lineitem").selectExpr("l_orderkey AS id", "l_returnflag = 'A' AS anchored", "l_returnflag = 'R' AS missing")
    return m.grounding(items)


GROUNDING = "SELECT l_orderkey AS id, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS anchored, count(*) FILTER (l_returnflag = 'R') AS missing, CASE WHEN bool_and(l_returnflag = 'R') THEN 'fail' WHEN bool_and(l_returnflag = 'A') THEN 'pass' ELSE 'flag' END AS verdict FROM lineitem GROUP BY 1"


def _combined(spark: SparkSession, sf: str) -> DataFrame:
    # Of lines at one place that stands first which does so in its file, as in a log that reviews are appended to.
    reviews = read(spark, sf, "lineitem").selectExpr("concat('J', l_linenumber % 4) AS judge", "CASE WHEN l_linenumber % 2 = 0 THEN concat('Item', l_orderkey) ELSE concat('item', l_orderkey) END AS id", "CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'flag' ELSE 'fail' END AS verdict", "CASE WHEN l_discount > 0 THEN l_discount * 0.8317e0 END AS confidence", "CASE WHEN l_tax > 0.01 THEN concat('because ', l_partkey) END AS reason", "struct(l_linenumber * 1000000 + l_partkey AS at, _metadata.file_path AS file, _metadata.row_index AS row) AS place")
    judges = spark.createDataFrame([("J0", None, True), ("J1", 2.0, False), ("J2", 0.5, None), ("J3", 1.0, False)], "judge string, weight double, critical boolean")
    return m.combined(reviews, judges)


_C = """r AS (SELECT *, row_number() OVER (PARTITION BY judge, id ORDER BY place) AS r FROM (SELECT 'J' || l_linenumber % 4 AS judge, 'item' || l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'flag' ELSE 'fail' END AS verdict, CASE WHEN l_discount > 0 THEN l_discount * 0.8317e0 ELSE 0.5e0 END AS c, CASE WHEN l_tax > 0.01 THEN 'because ' || l_partkey END AS reason, l_linenumber * 1000000 + l_partkey AS place FROM lineitem)),
f AS (SELECT *, (CASE judge WHEN 'J1' THEN 2.0 WHEN 'J2' THEN 0.5 ELSE 1.0 END)::DOUBLE AS w, judge = 'J0' AND verdict = 'fail' AS gate FROM r WHERE r = 1),
c AS (SELECT id, round_even(sum(w * c * CASE verdict WHEN 'pass' THEN 1.0 WHEN 'flag' THEN 0.5 ELSE 0.0 END) / sum(w), 4) AS score, string_agg(judge || ':' || verdict, ', ' ORDER BY judge, verdict) AS said, CASE WHEN bool_or(verdict = 'fail') THEN first(reason ORDER BY place) FILTER (verdict = 'fail') ELSE first(reason ORDER BY place) FILTER (verdict = 'flag') END AS why,
  bool_or(gate) AS dropped, coalesce(string_agg(DISTINCT judge, ',') FILTER (gate), '') AS dropped_by, first(reason ORDER BY place) FILTER (gate) AS reason FROM f GROUP BY 1),
d AS (SELECT id, score, left(said || CASE WHEN coalesce(why, '') <> '' THEN ' — ' || why ELSE '' END, 280) AS remarks, dropped, dropped_by, reason FROM c)"""


def combined_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Scores, remarks and drops of items by their judges; a judge's second review doesn't count."""
    return _combined(spark, sf)


COMBINED = f"WITH {_C} SELECT * FROM d"


def verdict_operations(spark: SparkSession, sf: str) -> DataFrame:
    """The operations that verdicts ask for."""
    return m.operations(_combined(spark, sf))


OPERATIONS = f"WITH {_C} SELECT id, CASE WHEN dropped THEN 'drop' WHEN score >= 0.75 THEN 'approve' ELSE 'note' END AS op, CASE WHEN dropped THEN coalesce(reason, '') WHEN score >= 0.75 THEN '' ELSE remarks END AS reason FROM d"


def human_queue(spark: SparkSession, sf: str) -> DataFrame:
    """What a human should look at, and how urgently."""
    rows = read(spark, sf, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 7 > 0 THEN c_nationkey / 25e0 END AS score", "c_custkey % 5 = 0 AS escalated", "c_custkey % 3 = 0 AS reviewed", "c_custkey % 11 = 0 AS dropped")
    return m.review_queue(rows, 0.5)


QUEUE = "SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 2 WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS part, coalesce(CASE WHEN c_custkey % 7 > 0 THEN c_nationkey / 25e0 END, 1.0) AS urgency FROM customer WHERE c_custkey % 11 = 0 OR ((c_custkey % 5 = 0 OR (c_custkey % 7 > 0 AND c_nationkey / 25e0 < 0.5)) AND c_custkey % 3 > 0)"


def relation_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of relations: in their sentence, by surface, by plural, or open."""
    lines = read(spark, sf, "lineitem")
    held = lines.selectExpr("l_partkey AS `group`", "concat(CASE WHEN l_linenumber % 2 = 0 THEN 'Cell ' ELSE 'cell  ' END, l_partkey - l_partkey % 3 * (l_partkey % 2), CASE WHEN l_partkey % 5 = 0 THEN 's' ELSE '' END) AS surface", "l_orderkey AS sentence")
    asked = lines.where("l_linenumber = 1").selectExpr("l_orderkey * 100 + l_partkey % 100 AS rel", "l_partkey AS source", "concat('cell ', l_suppkey * 3 + l_orderkey % 3, CASE WHEN l_orderkey % 4 = 0 THEN 's' ELSE '' END) AS target", "l_orderkey AS sentence").dropDuplicates(["rel"])
    asked = lines.where("l_linenumber = 1").groupBy((F.col("l_orderkey")).alias("rel")).agg(F.min("l_partkey").alias("source"), F.max("l_suppkey").alias("k")).selectExpr("rel", "source", "concat('cell ', k * 3 + rel % 3, CASE WHEN rel % 4 = 0 THEN 's' ELSE '' END) AS target", "rel AS sentence")
    return m.resolved(asked, held)


RELATIONS = """
WITH h AS (SELECT DISTINCT l_partkey AS g, 'cell ' || (l_partkey - l_partkey % 3 * (l_partkey % 2)) || CASE WHEN l_partkey % 5 = 0 THEN 's' ELSE '' END AS t, l_orderkey AS sentence FROM lineitem), s AS (SELECT DISTINCT g, t FROM h),
a AS (SELECT rel, source, 'cell ' || (k * 3 + rel % 3) || CASE WHEN rel % 4 = 0 THEN 's' ELSE '' END AS target FROM (SELECT l_orderkey AS rel, min(l_partkey) AS source, max(l_suppkey) AS k FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)),
x AS (SELECT a.rel, count(DISTINCT g) AS n, min(g) AS g FROM a JOIN h ON h.t = target AND h.sentence = a.rel AND g <> source GROUP BY 1), y AS (SELECT a.rel, count(DISTINCT g) AS n, min(g) AS g FROM a JOIN s ON s.t = target AND g <> source GROUP BY 1),
z AS (SELECT a.rel, count(DISTINCT g) AS n, min(g) AS g FROM a JOIN s ON s.t = CASE WHEN target LIKE '%s' THEN left(target, length(target) - 1) ELSE target || 's' END AND g <> source GROUP BY 1)
SELECT a.rel, source, target, CASE WHEN x.n = 1 THEN x.g WHEN y.n = 1 THEN y.g WHEN y.n IS NULL AND z.n = 1 THEN z.g END AS resolved FROM a LEFT JOIN x ON x.rel = a.rel LEFT JOIN y ON y.rel = a.rel LEFT JOIN z ON z.rel = a.rel
"""


def operation_log(spark: SparkSession, sf: str) -> DataFrame:
    """K1: the result of every operation of a log and the state after it."""
    ops = read(spark, sf, "orders").selectExpr("o_custkey AS id", "o_orderkey AS place", "CASE WHEN o_orderkey % 3 = 0 THEN 'human' ELSE 'judge' END AS actor", "CASE o_orderkey % 8 WHEN 0 THEN 'approve' WHEN 1 THEN 'drop' WHEN 2 THEN 'restore' WHEN 3 THEN 'set' WHEN 4 THEN 'demote' WHEN 5 THEN 'remap' WHEN 6 THEN 'note' ELSE 'erase' END AS op", "CASE WHEN o_orderkey % 5 > 0 THEN 'label' ELSE 'other' END AS field", "CASE WHEN o_orderkey % 7 > 0 THEN concat('v', o_orderkey) ELSE '' END AS value")
    return m.fold_log(ops)


LOG = """
WITH RECURSIVE o AS (SELECT o_custkey AS id, o_orderkey AS place, o_orderkey % 3 = 0 AS human, (['approve', 'drop', 'restore', 'set', 'demote', 'remap', 'note', 'erase'])[o_orderkey % 8 + 1] AS op, o_orderkey % 5 > 0 AS is_label, CASE WHEN o_orderkey % 7 > 0 THEN 'v' || o_orderkey ELSE '' END AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
w AS (SELECT id, 0::BIGINT AS k, NULL::BIGINT AS place, '' AS result, false AS dropped, NULL::VARCHAR AS label, 'initial' AS mapping FROM (SELECT DISTINCT id FROM o)
UNION ALL SELECT id, k, place, result, CASE WHEN result = 'applied' AND op = 'drop' THEN true WHEN result = 'applied' AND op = 'restore' THEN false ELSE was END, CASE WHEN result = 'applied' AND op = 'set' THEN value ELSE label END, CASE WHEN result = 'applied' AND op = 'remap' THEN value WHEN result = 'applied' AND op = 'demote' THEN NULL ELSE mapping END
FROM (SELECT o.id, o.k, o.place, o.op, o.value, w.dropped AS was, w.label, w.mapping, CASE WHEN op = 'erase' THEN 'rejected: unknown operation' WHEN op = 'restore' AND NOT human THEN 'rejected: only a human restores' WHEN op = 'restore' AND NOT w.dropped THEN 'rejected: was not dropped' WHEN op <> 'restore' AND w.dropped THEN 'rejected: is dropped'
  WHEN op = 'set' AND NOT is_label THEN 'rejected: no such field' WHEN op = 'remap' AND value = '' THEN 'rejected: no value' ELSE 'applied' END AS result FROM w JOIN o ON o.id = w.id AND o.k = w.k + 1))
SELECT id, place, result, dropped, label, mapping FROM w WHERE k > 0
"""


def sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """chunks of texts of sentences, each with a sentence of the one before, at their places in the text."""
    text = "concat('Dr. A. Smith saw it. ', repeat('X', p_size * 3), ' went on! ', p_name, ' et al. The end came. \"Quoted\" words, e.g. Many, are here? ', repeat('Y', p_size), '. last one')"
    rows = read(spark, sf, "part").selectExpr("p_partkey", "p_size", f"CASE WHEN p_partkey % 20 = 0 THEN '' ELSE {text} END AS text")
    found = rows.select("p_partkey", "text", F.posexplode(m.chunk_spans(F.col("text"), 100)).alias("place", "x"))
    return found.select("p_partkey", "place", F.col("x.s").alias("start"), F.expr("substring(text, x.s + 1, x.e - x.s)").alias("chunk"))


_S = """p AS (SELECT p_partkey, ['Dr. A. Smith saw it.', repeat('X', p_size * 3) || ' went on! ' || p_name || ' et al. The end came.', '"Quoted" words, e.g. Many, are here?', repeat('Y', p_size) || '. last one'] AS s FROM part WHERE p_partkey % 20 > 0)"""
CHUNKS = f"""
WITH RECURSIVE {_S}, i AS (SELECT p_partkey, k, s[k] AS sentence, (SELECT coalesce(sum(length(s[j]) + 1), 0) FROM range(1, k) r(j))::BIGINT AS a FROM p, range(1, 5) q(k)), t AS (SELECT *, a + length(sentence) AS b, (SELECT length(array_to_string(s, ' ')) FROM p WHERE p.p_partkey = i.p_partkey) AS total FROM i),
g AS (SELECT p_partkey, 1::BIGINT AS k, 1::BIGINT AS first FROM t WHERE k = 1 UNION ALL SELECT g.p_partkey, g.k + 1, CASE WHEN n.b - f.a <= 100 THEN g.first ELSE g.k + 1 END FROM g JOIN t n ON n.p_partkey = g.p_partkey AND n.k = g.k + 1 JOIN t f ON f.p_partkey = g.p_partkey AND f.k = g.first),
c AS (SELECT p_partkey, first, max(k) AS last, row_number() OVER (PARTITION BY p_partkey ORDER BY first) - 1 AS place, lag(first) OVER (PARTITION BY p_partkey ORDER BY first) AS before FROM g GROUP BY 1, 2),
d AS (SELECT c.p_partkey, place, x.a AS s, y.b AS e, x.total FROM c JOIN t x ON x.p_partkey = c.p_partkey AND x.k = CASE WHEN before IS NULL THEN first ELSE greatest(before + 1, first - 1) END JOIN t y ON y.p_partkey = c.p_partkey AND y.k = c.last)
SELECT d.p_partkey, place::INTEGER AS place, d.s::INTEGER AS start, substr(array_to_string(p.s, ' '), d.s + 1, e - d.s) AS chunk FROM d JOIN p USING (p_partkey) WHERE total > 100
UNION ALL SELECT p_partkey, 0, 0, array_to_string(s, ' ') FROM p WHERE length(array_to_string(s, ' ')) <= 100 UNION ALL SELECT p_partkey, 0, 0, '' FROM part WHERE p_partkey % 20 = 0
"""


def construct_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """What papers find about a construct; papers that only study it count as such, but have no direction."""
    lines = read(spark, sf, "lineitem", "l_partkey", "l_orderkey", "l_returnflag", "l_discount")
    direction = F.when(F.col("l_returnflag") == "R", "negative").when(F.col("l_discount") >= 0.07, "positive").when(F.col("l_discount") >= 0.05, "null").when(F.col("l_discount") >= 0.03, "mixed")
    return roles.consensus(lines.select(F.col("l_partkey").alias("construct"), F.col("l_orderkey").alias("paper"), direction.alias("direction")))


CONSENSUS = """
WITH c AS (SELECT DISTINCT l_partkey AS construct, l_orderkey AS paper, CASE WHEN l_returnflag = 'R' THEN 'negative' WHEN l_discount >= 0.07 THEN 'positive' WHEN l_discount >= 0.05 THEN 'null' WHEN l_discount >= 0.03 THEN 'mixed' END AS direction FROM lineitem),
a AS (SELECT construct, count(DISTINCT paper) AS papers, count(DISTINCT paper) FILTER (direction IS NOT NULL) AS directed, count(*) FILTER (direction = 'positive') AS positive, count(*) FILTER (direction = 'negative') AS negative, count(*) FILTER (direction = 'null') AS neutral FROM c GROUP BY 1),
b AS (SELECT *, greatest(positive, negative, neutral) AS top, positive + negative + neutral AS claims FROM a)
SELECT construct, papers, directed, positive, negative, neutral, CASE WHEN claims = 0 THEN 0.0 ELSE round_even(top / claims, 3) END AS agreement,
  CASE WHEN directed = 0 THEN 'no_directional_finding' WHEN directed < 2 THEN 'insufficient_papers' WHEN positive > 0 AND negative > 0 THEN 'divergent' WHEN claims > 0 AND top / claims >= 0.7 THEN 'consensus' ELSE 'mixed' END AS verdict FROM b
"""


def variable_roles(spark: SparkSession, sf: str) -> DataFrame:
    """The role that papers give a variable: consistent only where share and exclusivity both reach the threshold."""
    orders = read(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    role = F.when(F.col("o_orderkey") % 4 == 0, "unspecified").when(F.col("o_custkey") % 3 == 0, "outcome").otherwise(F.col("o_orderpriority"))
    return roles.variable_roles(orders.select(F.col("o_custkey").alias("variable"), F.year("o_orderdate").alias("paper"), role.alias("role")))


ROLES = """
WITH p AS (SELECT DISTINCT o_custkey AS variable, year(o_orderdate) AS paper, CASE WHEN o_orderkey % 4 = 0 THEN 'unspecified' WHEN o_custkey % 3 = 0 THEN 'outcome' ELSE o_orderpriority END AS role FROM orders),
n AS (SELECT variable, count(DISTINCT paper) AS papers FROM p GROUP BY 1), s AS (SELECT * FROM p WHERE role <> 'unspecified'), o AS (SELECT variable, paper, count(*) AS roles FROM s GROUP BY 1, 2),
c AS (SELECT s.variable, role, count(*) AS n, count(*) FILTER (roles = 1) AS alone, count(*) OVER (PARTITION BY s.variable) AS claimed, row_number() OVER (PARTITION BY s.variable ORDER BY count(*) DESC, role) AS k FROM s JOIN o USING (variable, paper) GROUP BY 1, 2)
SELECT variable, papers, role AS dominant_role, round_even(coalesce(n, 0) / papers, 3) AS share, round_even(coalesce(alone, 0) / papers, 3) AS exclusivity,
  CASE WHEN papers < 2 THEN 'insufficient_papers' WHEN n / papers >= 0.7 AND alone / papers >= 0.7 THEN 'consistent_role' WHEN claimed > 1 THEN 'contested_role' WHEN role IS NOT NULL THEN 'mixed' ELSE 'unspecified_role' END AS verdict FROM n LEFT JOIN (SELECT * FROM c WHERE k = 1) USING (variable)
"""


def role_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The roles of each variable in each model, joined by a slash."""
    orders = read(spark, sf, "orders", "o_custkey", "o_orderstatus", "o_orderpriority")
    return roles.matrix(orders.select(F.col("o_custkey").alias("variable"), F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("role")), ["F", "O", "P"])


MATRIX = "SELECT o_custkey AS variable, " + ", ".join(f"coalesce(string_agg(DISTINCT o_orderpriority, '/' ORDER BY o_orderpriority) FILTER (o_orderstatus = '{s}'), '') AS {s}" for s in "FOP") + " FROM orders GROUP BY 1"


def claim_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Papers for and against each claim, and its caveats."""
    lines = read(spark, sf, "lineitem").selectExpr("l_partkey AS claim", "l_orderkey AS paper", "l_returnflag <> 'R' AS supports", "CASE WHEN l_discount = 0 THEN 'no effect size' WHEN l_tax > 0.06 THEN 'subgroup' END AS caveat")
    return roles.claims(lines)


CLAIMS = "SELECT l_partkey AS claim, count(DISTINCT l_orderkey) FILTER (l_returnflag <> 'R') AS supporting, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS contradicting, coalesce(string_agg(DISTINCT CASE WHEN l_discount = 0 THEN 'no effect size' WHEN l_tax > 0.06 THEN 'subgroup' END, '; '  ORDER BY CASE WHEN l_discount = 0 THEN 'no effect size' WHEN l_tax > 0.06 THEN 'subgroup' END), '') AS caveats FROM lineitem GROUP BY 1"

_KINDS = ["declared", "model", "study", "measure", "finding", "involves"]
_ROLES = ["predictor", "outcome", "mediator", "moderator", "covariate"]


def _facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Lines as facts: orders are papers, parts constructs, suppliers variables."""
    lines = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("l_partkey") + F.col("l_linenumber")) % 6)
    role = F.when(F.col("l_suppkey") % 3 == 0, F.get(F.array(*[F.lit(r) for r in _ROLES]), F.col("l_suppkey") % 5)).when(F.col("l_linenumber") < 4, F.get(F.array(*[F.lit(r) for r in _ROLES]), F.col("l_linenumber") % 5))
    direction = F.when(F.col("l_partkey") % 4 == 0, "positive").when(F.col("l_returnflag") == "R", "negative").when(F.col("l_returnflag") == "A", "null").when(F.col("l_returnflag") == "N", "positive")
    facts = lines.select(kind.alias("kind"), F.col("l_orderkey").alias("paper"), (F.col("l_partkey") % 500).alias("construct"), F.col("l_suppkey").alias("variable"), role.alias("role"), direction.alias("direction"))
    facts = facts.withColumns({"construct": F.when(F.col("kind").isin("study", "measure", "finding", "involves"), F.col("construct")), "variable": F.when(~F.col("kind").isin("study", "finding"), F.col("variable"))})
    return facts, read(spark, sf, "supplier").where("s_suppkey % 2 = 0").selectExpr("s_suppkey AS variable", "concat('t', s_nationkey) AS table")


def synthesis_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Constructs, variables and links between them over all papers, counted at all levels in one pass, with their verdicts."""
    return synthesis.synthesis(*_facts(spark, sf))[0]


def synthesis_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The totals of the whole synthesis."""
    return synthesis.synthesis(*_facts(spark, sf))[1]


_SYNTHESIS = f"""
WITH raw AS (SELECT {_KINDS}[(l_partkey + l_linenumber) % 6 + 1] AS kind, l_orderkey AS paper, l_partkey % 500 AS part, l_suppkey AS supplier, CASE WHEN l_suppkey % 3 = 0 THEN {_ROLES}[l_suppkey % 5 + 1] WHEN l_linenumber < 4 THEN {_ROLES}[l_linenumber % 5 + 1] END AS role,
             CASE WHEN l_partkey % 4 = 0 THEN 'positive' WHEN l_returnflag = 'R' THEN 'negative' WHEN l_returnflag = 'A' THEN 'null' WHEN l_returnflag = 'N' THEN 'positive' END AS direction FROM lineitem),
f AS (SELECT kind, paper, CASE WHEN kind NOT IN ('declared', 'model') THEN part END AS construct, CASE WHEN kind NOT IN ('study', 'finding') THEN supplier END AS variable, role, direction FROM raw),
lv AS (SELECT CASE WHEN grouping(construct) = 1 AND grouping(variable) = 1 THEN 'all' WHEN grouping(variable) = 1 THEN 'construct' WHEN grouping(construct) = 1 THEN 'variable' ELSE 'link' END AS level, construct, variable, count(DISTINCT paper) AS papers,
       count(DISTINCT paper) FILTER (kind = 'declared') AS declared, count(DISTINCT paper) FILTER (kind = 'measure') AS measured, count(DISTINCT paper) FILTER (kind = 'involves') AS involved, count(*) FILTER (kind = 'declared') AS uses, count(*) FILTER (kind = 'finding') AS findings
       FROM f GROUP BY GROUPING SETS ((construct), (variable), (construct, variable), ())),
l AS (SELECT * FROM lv WHERE level = 'all' OR (level = 'construct' AND construct IS NOT NULL) OR (level = 'variable' AND variable IS NOT NULL) OR (level = 'link' AND construct IS NOT NULL AND variable IS NOT NULL)),
c AS (SELECT DISTINCT construct, paper, CASE WHEN kind = 'finding' THEN coalesce(direction, 'unspecified') END AS direction FROM f WHERE construct IS NOT NULL),
a AS (SELECT construct, count(DISTINCT paper) FILTER (direction IS NOT NULL) AS directed, count(*) FILTER (direction = 'positive') AS positive, count(*) FILTER (direction = 'negative') AS negative, count(*) FILTER (direction = 'null') AS neutral FROM c GROUP BY 1),
cv AS (SELECT construct, CASE WHEN positive + negative + neutral = 0 THEN 0.0 ELSE round_even(greatest(positive, negative, neutral) / (positive + negative + neutral), 3) END AS agreement,
       CASE WHEN directed = 0 THEN 'no_directional_finding' WHEN directed < 2 THEN 'insufficient_papers' WHEN positive > 0 AND negative > 0 THEN 'divergent' WHEN positive + negative + neutral > 0 AND greatest(positive, negative, neutral) / (positive + negative + neutral) >= 0.7 THEN 'consensus' ELSE 'mixed' END AS verdict FROM a),
p AS (SELECT DISTINCT variable, paper, CASE WHEN kind IN ('declared', 'model') THEN coalesce(role, 'unspecified') WHEN role IN ('mediator', 'moderator') THEN role ELSE 'unspecified' END AS role FROM f WHERE variable IS NOT NULL),
n AS (SELECT variable, count(DISTINCT paper) AS papers FROM p GROUP BY 1), s AS (SELECT * FROM p WHERE role <> 'unspecified'), o AS (SELECT variable, paper, count(*) AS roles FROM s GROUP BY 1, 2),
r AS (SELECT s.variable, role, count(*) AS n, count(*) FILTER (roles = 1) AS alone, count(*) OVER (PARTITION BY s.variable) AS claimed, row_number() OVER (PARTITION BY s.variable ORDER BY count(*) DESC, role) AS k FROM s JOIN o USING (variable, paper) GROUP BY 1, 2),
vv AS (SELECT variable, role AS dominant_role, round_even(coalesce(n, 0) / papers, 3) AS agreement, CASE WHEN papers < 2 THEN 'insufficient_papers' WHEN n / papers >= 0.7 AND alone / papers >= 0.7 THEN 'consistent_role' WHEN claimed > 1 THEN 'contested_role' WHEN role IS NOT NULL THEN 'mixed' ELSE 'unspecified_role' END AS verdict FROM n LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (variable)),
w AS (SELECT l.*, coalesce(cv.agreement, vv.agreement) AS agreement, coalesce(cv.verdict, vv.verdict) AS verdict, dominant_role, CASE WHEN s_suppkey % 2 = 0 THEN 't' || s_nationkey END AS "table"
      FROM l LEFT JOIN cv ON level = 'construct' AND cv.construct = l.construct LEFT JOIN vv ON level = 'variable' AND vv.variable = l.variable LEFT JOIN supplier ON level = 'variable' AND s_suppkey = l.variable)
"""
SYNTHESIS_LEVELS = _SYNTHESIS + "SELECT level, construct, variable, papers, declared, measured, involved, uses, findings, agreement, verdict, dominant_role, \"table\" FROM w"
SYNTHESIS_TOTALS = _SYNTHESIS + """SELECT max(papers) FILTER (level = 'all') AS papers, max(uses) FILTER (level = 'all') AS variable_uses, max(findings) FILTER (level = 'all') AS findings, count(*) FILTER (level = 'variable') AS distinct_variables, count(*) FILTER (level = 'construct') AS distinct_constructs, count(*) FILTER (level = 'link') AS links,
count(*) FILTER (level = 'variable' AND "table" IS NOT NULL) AS variables_with_table, count(*) FILTER (level = 'construct' AND verdict = 'consensus') AS consensus_constructs, count(*) FILTER (level = 'construct' AND verdict = 'divergent') AS divergent_constructs,
count(*) FILTER (verdict = 'consistent_role' AND dominant_role = 'mediator') AS consistent_mediators, count(*) FILTER (verdict = 'consistent_role' AND dominant_role = 'moderator') AS consistent_moderators, count(*) FILTER (verdict = 'contested_role') AS contested_roles FROM w"""

QUERIES = {
    "synthesis_levels": (synthesis_levels, SYNTHESIS_LEVELS),
    "synthesis_totals": (synthesis_totals, SYNTHESIS_TOTALS),
    "mention_groups": (mention_groups, GROUPS),
    "mention_sentences": (mention_sentences, SENTENCES),
    "unified_mappings": (unified_mappings, UNIFIED),
    "corpus_form_index": (corpus_form_index, INDEX),
    "corpus_totals": (corpus_totals, TOTALS),
    "ordered_groups": (ordered_groups, ORDERED),
    "grounding_verdicts": (grounding_verdicts, GROUNDING),
    "combined_verdicts": (combined_verdicts, COMBINED),
    "verdict_operations": (verdict_operations, OPERATIONS),
    "human_queue": (human_queue, QUEUE),
    "relation_targets": (relation_targets, RELATIONS),
    "operation_log": (operation_log, LOG),
    "sentence_chunks": (sentence_chunks, CHUNKS),
    "construct_consensus": (construct_consensus, CONSENSUS),
    "variable_roles": (variable_roles, ROLES),
    "role_matrix": (role_matrix, MATRIX),
    "claim_sides": (claim_sides, CLAIMS),
}
