"""Competency questions over entities, asked of a graph that is made from the order tables.

Parts are entities, lines their mentions and assertions, suppliers papers, orders causal claims, customers change
records, events reviews, nations runs and judges.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from brindle.graph import entities as q
from brindle.graph.tables import Tables
from brindle.sources.tables import read

_TERM = "CASE WHEN p_partkey % 13 = 0 THEN concat('https://graph.example/concept/', p_partkey) ELSE concat('http://purl.obolibrary.org/obo/', CASE p_partkey % 4 WHEN 0 THEN 'HP' WHEN 1 THEN 'MP' WHEN 2 THEN 'PATO' ELSE 'NCBITaxon' END, '_', p_partkey % 97) END"
_PREFIX = "CASE WHEN p_partkey % 13 = 0 THEN 'LOCAL' ELSE CASE p_partkey % 4 WHEN 0 THEN 'HP' WHEN 1 THEN 'MP' WHEN 2 THEN 'PATO' ELSE 'NCBITaxon' END END"
_OBJECT = "cast((l_orderkey - l_orderkey % 8) / 8 AS bigint)"
_CURRENT = "o_orderkey * 2 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END"

#: The graph's tables, in SQL that Spark and the oracle both run; a name in braces is a table of the data or of this graph.
TABLES = {
    "entity": "SELECT p_partkey AS e, concat(p_name, ' ', p_partkey) AS key, p_name AS label, CASE WHEN p_size > 40 THEN concat('gap ', p_size) END AS comment FROM {part}",
    "entity_class": """SELECT p_partkey AS e, CASE p_size % 12 WHEN 0 THEN 'Neuron' WHEN 1 THEN 'Drug' WHEN 2 THEN 'Strain' WHEN 3 THEN 'Assay' WHEN 4 THEN 'Measurement' WHEN 5 THEN 'BehavioralPhenotype'
        WHEN 6 THEN 'Species' WHEN 7 THEN 'Astrocyte' WHEN 8 THEN 'NamedEntity' WHEN 9 THEN 'Software' WHEN 10 THEN 'Symptom' ELSE 'Interneuron' END AS cls FROM {part} UNION ALL SELECT p_partkey, 'CellType' FROM {part} WHERE p_partkey % 9 = 0""",
    "entity_source": "SELECT DISTINCT l_partkey AS e, l_suppkey AS pub FROM {lineitem}",
    "source": "SELECT s_suppkey AS pub, CASE WHEN s_suppkey % 5 <> 0 THEN concat('10.5555/s', s_suppkey) END AS doi, s_name AS title, CASE WHEN s_suppkey % 11 <> 0 THEN concat(1990 + s_suppkey % 30, '-01-15') END AS issued FROM {supplier}",
    "mention": """SELECT l_orderkey * 8 + l_linenumber AS m, l_partkey AS e, concat('form  ', l_returnflag, l_linestatus, ' ', l_partkey) AS surface, cast(floor(l_extendedprice) AS bigint) AS start_at,
        cast(floor(l_extendedprice) + l_quantity AS bigint) AS end_at, l_suppkey * 10 + l_linenumber % 3 AS dv, CASE WHEN l_linestatus = 'F' THEN l_linenumber END AS snapshot, CASE WHEN l_linenumber < 6 THEN l_discount END AS confidence FROM {lineitem}""",
    "version": "SELECT DISTINCT l_suppkey * 10 + l_linenumber % 3 AS dv, l_suppkey AS pub FROM {lineitem}",
    "mapping": f"SELECT p_partkey AS e, CASE p_size % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'close' WHEN 2 THEN 'broad' WHEN 3 THEN 'narrow' ELSE 'related' END AS tier, {_TERM} AS term FROM {{part}} WHERE p_size % 6 < 5",
    "concept": f"""SELECT DISTINCT {_TERM} AS c, {_TERM} AS iri, concat({_PREFIX}, ':', CASE WHEN p_partkey % 13 = 0 THEN p_partkey ELSE p_partkey % 97 END) AS curie,
        CASE WHEN p_partkey % 97 % 3 <> 0 THEN concat('term ', p_partkey % 97) END AS label, CASE WHEN p_partkey % 13 = 0 THEN 'local' ELSE {_PREFIX} END AS acronym FROM {{part}}""",
    "resolved": "SELECT e, term AS c FROM {mapping}",
    "decision": """SELECT p_partkey AS dec, p_partkey AS e, CASE WHEN p_size % 6 < 4 THEN 'accepted' ELSE 'proposed' END AS status, CASE WHEN p_partkey % 4 <> 0 THEN p_size / 50e0 END AS confidence,
        CASE p_partkey % 3 WHEN 0 THEN 'lexical' WHEN 1 THEN 'hybrid' END AS method, CASE p_partkey % 5 WHEN 0 THEN 'trusted' WHEN 1 THEN 'local' ELSE 'remote' END AS source FROM {part} WHERE p_size % 6 < 5""",
    "candidate": """SELECT p_partkey AS dec, p_partkey * 2 AS cand, 1 AS mapping_rank, CASE WHEN p_partkey % 3 = 0 THEN 'cosine' END AS score_type, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS score_value FROM {part} WHERE p_size % 4 > 0
        UNION ALL SELECT p_partkey, p_partkey * 2 + 1, 2, NULL, NULL FROM {part} WHERE p_partkey % 2 = 0""",
    "assertion": f"""SELECT l_orderkey * 8 + l_linenumber AS a, l_partkey AS subject, CASE l_linenumber WHEN 1 THEN 'RO_0002292' WHEN 2 THEN 'RO_0001025' WHEN 3 THEN 'RO_0002162' WHEN 4 THEN 'RO_0002200' ELSE 'has_layer' END AS predicate,
        {_OBJECT} AS object, l_suppkey AS pub, CASE WHEN l_discount < 0.09 THEN l_returnflag = 'R' END AS negated, CASE WHEN l_linestatus = 'O' THEN 'asserted' END AS modality,
        CASE WHEN l_linenumber % 2 = 0 THEN concat('context ', l_linenumber) END AS context, concat('seen  in ', l_orderkey) AS evidence FROM {{lineitem}}""",
    "edge": f"""SELECT DISTINCT l_partkey AS s, CASE l_linenumber WHEN 1 THEN 'part_of' WHEN 2 THEN 'participant' WHEN 3 THEN 'participates_in' WHEN 5 THEN 'see_also' ELSE 'used' END AS p, {_OBJECT} AS o FROM {{lineitem}} WHERE l_linenumber IN (1, 2, 3, 5, 6)
        UNION ALL SELECT p_partkey, 'broader', cast((p_partkey - p_partkey % 7) / 7 AS bigint) FROM {{part}} WHERE p_partkey > 0 UNION ALL SELECT p_partkey, 'derived_from', cast((p_partkey - p_partkey % 5) / 5 AS bigint) FROM {{part}} WHERE p_partkey > 0""",
    "causal": f"SELECT o_orderkey AS rel, o_custkey % 100 AS cause, 100 + o_orderkey % 100 AS effect, cast((o_orderkey - o_orderkey % 150) / 150 AS bigint) AS pub, {_CURRENT} AS v FROM {{orders}}",
    "causal_version": """SELECT o_orderkey * 2 AS v, o_orderkey AS rel, 1 AS revision, o_orderstatus = 'F' AS negated, o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') AS hypothetical, CASE o_orderpriority WHEN '1-URGENT' THEN 'positive' WHEN '2-HIGH' THEN 'negative' END AS polarity,
        cast(o_orderdate AS date) AS valid_from, CASE WHEN o_orderkey % 3 = 0 THEN cast(o_orderdate AS date) END AS valid_until, CASE WHEN o_orderkey % 2 = 0 THEN concat('as ', o_orderpriority) END AS evidence FROM {orders}
        UNION ALL SELECT o_orderkey * 2 + 1, o_orderkey, 2, o_orderstatus = 'O', o_custkey % 4 = 0, 'positive', cast(o_orderdate AS date), NULL, 'second' FROM {orders} WHERE o_orderkey % 3 = 0""",
    "causal_basis": "SELECT o_orderkey * 2 AS v, CASE o_orderkey % 3 WHEN 1 THEN 'intervention' ELSE 'correlation' END AS basis FROM {orders} WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey * 2 + 1, 'simulation' FROM {orders} WHERE o_orderkey % 6 = 0",
    "causal_third": "SELECT o_orderkey AS rel, 'mediator' AS role, o_orderkey % 150 AS third FROM {orders} WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'moderator', o_orderkey % 130 FROM {orders} WHERE o_orderkey % 5 = 1 UNION ALL SELECT o_orderkey, 'confounder', o_orderkey % 110 FROM {orders} WHERE o_orderkey % 7 = 0",
    "estimate": f"SELECT o_orderkey AS est, {_CURRENT} AS v, CASE o_orderkey % 3 WHEN 0 THEN 'odds ratio' ELSE 'beta' END AS measure, o_totalprice AS value, CASE WHEN o_orderkey % 10 < 9 THEN o_orderkey % 100 / 1000e0 END AS p, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS n FROM {{orders}} WHERE o_orderkey % 3 <> 1",
    "chain": "SELECT c_custkey AS chain, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS label FROM {customer}",
    "chain_relation": "SELECT o_custkey AS chain, o_orderkey AS rel FROM {orders}",
    "next_relation": "SELECT rel, following FROM (SELECT o_orderkey AS rel, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS following FROM {orders}) AS f WHERE following IS NOT NULL",
    "run": """SELECT n_nationkey AS run, concat('run-', n_nationkey) AS run_id, CASE WHEN n_nationkey % 4 > 0 THEN 2000 + n_nationkey END AS started, CASE WHEN n_nationkey % 5 > 0 THEN 2001 + n_nationkey END AS ended,
        CASE WHEN n_nationkey % 6 > 0 THEN n_regionkey END AS agent, CASE WHEN n_nationkey % 3 > 0 THEN concat('cfg-', n_nationkey) END AS cfg, CASE WHEN n_nationkey % 3 > 0 THEN concat('hash-', n_nationkey) END AS cfg_hash FROM {nation}""",
    "agent": "SELECT r_regionkey AS agent, r_name AS label, CASE WHEN r_regionkey <> 2 THEN concat('v', r_regionkey) END AS version FROM {region}",
    "snapshot": "SELECT n_nationkey AS snapshot, (n_nationkey * 3) % 25 AS run, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS label, CASE WHEN n_nationkey % 3 > 0 THEN concat('dropped ', n_nationkey) END AS summary, 2010 + n_nationkey AS generated FROM {nation} WHERE n_nationkey BETWEEN 1 AND 7",
    "review": "SELECT event_id AS rd, event_type AS dimension, CASE WHEN value < 10 THEN 'pass' ELSE 'flag' END AS status, CASE WHEN event_id % 3 <> 0 THEN value END AS confidence, CASE WHEN event_id % 2 = 0 THEN props END AS comment, CASE WHEN event_id % 7 <> 0 THEN user_id % 5 END AS agent FROM {events}",
    "entity_review": "SELECT user_id % 200 AS e, event_id AS rd FROM {events} WHERE event_id % 2 = 0",
    "mention_review": "SELECT event_id AS m, event_id AS rd FROM {events} WHERE event_id % 2 = 1",
    "validation": """SELECT n_nationkey AS act, concat(CASE WHEN n_nationkey % 3 <> 0 THEN 'judge:' ELSE 'tool:' END, n_name) AS judge, CASE WHEN n_nationkey % 8 > 0 THEN n_regionkey END AS agent, CASE WHEN n_nationkey % 2 = 0 THEN concat('prompt ', n_nationkey) END AS prompt,
        CASE WHEN n_nationkey % 2 = 0 THEN concat('hash ', n_nationkey) END AS hash, CASE WHEN n_nationkey % 5 = 0 THEN 'strict' END AS mode FROM {nation}""",
    "change": """SELECT c_custkey AS cr, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'MappingRemovedChange' WHEN 'MACHINERY' THEN 'ClassificationChangedChange' WHEN 'FURNITURE' THEN 'SpanChangedChange' WHEN 'HOUSEHOLD' THEN 'Other' ELSE 'MappingAddedChange' END AS kind,
        concat('field ', c_nationkey % 4) AS field, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS e, CASE WHEN c_custkey % 2 = 0 THEN concat('iri/', c_custkey) END AS old, CASE WHEN c_custkey % 5 = 0 THEN c_name END AS new,
        CASE WHEN c_nationkey % 6 > 0 THEN concat('because ', c_nationkey) END AS reason, CASE WHEN c_nationkey % 2 = 0 THEN concat('judge ', c_nationkey) END AS licensed_by FROM {customer}""",
    "entity_change": "SELECT c_custkey % 150 AS e, c_custkey AS cr FROM {customer} WHERE c_custkey % 4 = 0",
    "triple": """SELECT concat('e:', s) AS s, p, concat('e:', o) AS o FROM {edge} UNION ALL SELECT concat('e:', e), tier, term FROM {mapping} UNION ALL SELECT concat('e:', e), 'had_primary_source', concat('s:', pub) FROM {entity_source}
        UNION ALL SELECT concat('r:', rel), 'has_cause', concat('e:', cause) FROM {causal} UNION ALL SELECT concat('r:', rel), 'has_effect', concat('e:', effect) FROM {causal}""",
    "label": "SELECT concat('e:', e) AS node, label FROM {entity} UNION ALL SELECT concat('s:', pub), title FROM {source}",
}
DATA = ["part", "lineitem", "supplier", "orders", "customer", "events", "nation", "region"]


def graph_of(spark: SparkSession, sf: str, specs: dict[str, str]) -> Tables:
    """Tables of SQL over the data's tables and each other."""

    def maker(text: str):
        names = set(re.findall(r"\{(\w+)\}", text))
        return lambda tables: spark.sql(text, **{n: tables[n] if n in specs else read(spark, sf, n) for n in names})

    return Tables({name: maker(text) for name, text in specs.items()})


def with_tables(body: str, specs: dict[str, str]) -> str:
    """SQL whose common table expressions are those of ``specs`` that ``body`` needs."""
    wanted: set[str] = set()

    def need(name: str) -> None:
        if name in specs and name not in wanted:
            wanted.add(name)
            for other in re.findall(r"\{(\w+)\}", specs[name]):
                need(other)

    for word in set(re.findall(r"\w+", body)):
        need(word)
    made = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', specs[n])})" for n in specs if n in wanted]
    recursive = re.match(r"\s*WITH RECURSIVE", body)
    rest = re.sub(r"^\s*WITH( RECURSIVE)?", "", body) if recursive or body.lstrip().startswith("WITH") else None
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(made)}{', ' + rest if rest is not None else ' ' + body}"


_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_CELLS, _PHENOTYPES = _IN(q.CELLS), _IN(q.PHENOTYPES)
_MENTIONED = "(SELECT m, e, surface, pub, dv, snapshot FROM mention JOIN version USING (dv))"
_CLAIMS = "(SELECT c.rel, c.pub, c.cause, c.effect, c.v, a.key AS cause_key, b.key AS effect_key, negated, hypothetical, polarity, evidence FROM causal c JOIN causal_version x ON x.v = c.v JOIN entity a ON a.e = cause JOIN entity b ON b.e = effect)"
_EXTERNAL = "(SELECT * FROM concept WHERE upper(acronym) <> 'LOCAL')"
_CURIES = "(SELECT e, curie FROM resolved JOIN concept USING (c))"
_CELL = f"(SELECT DISTINCT e FROM entity_class WHERE cls IN {_CELLS})"
_YEARS = "(SELECT pub, substr(issued, 1, 4)::INTEGER AS year FROM source WHERE issued IS NOT NULL)"


def _edge(predicate: str) -> str:
    return f"(SELECT s, o, a.key AS s_key, b.key AS o_key FROM edge JOIN entity a ON a.e = s JOIN entity b ON b.e = o WHERE p = '{predicate}')"


def _asserted(predicate: str) -> str:
    return f"(SELECT subject, x.key AS subject_key, y.key AS object_key, a.pub, doi, negated, modality, context, evidence FROM assertion a JOIN entity x ON x.e = subject JOIN entity y ON y.e = object LEFT JOIN source s ON s.pub = a.pub WHERE predicate = '{predicate}')"


#: name -> (question, SQL)
QUESTIONS = {
    "cq1_of_type": (lambda t: q.of_type(t, "Drug"), "SELECT DISTINCT e, pub, label, doi FROM entity_class JOIN entity USING (e) JOIN entity_source USING (e) LEFT JOIN source USING (pub) WHERE cls = 'Drug'"),
    "cq2_surface_forms": (q.surface_forms, f"SELECT DISTINCT pub, key, surface, doi FROM {_MENTIONED} JOIN entity USING (e) LEFT JOIN source USING (pub)"),
    "cq3_mention_positions": (q.mention_positions, "SELECT DISTINCT m, v.pub, surface, start_at, end_at, doi FROM mention JOIN version v USING (dv) LEFT JOIN source s ON s.pub = v.pub"),
    "cq4_inventory": (q.inventory, "SELECT DISTINCT es.pub, doi, es.e, key, cls FROM entity_source es JOIN entity USING (e) JOIN entity_class c ON c.e = es.e LEFT JOIN source s ON s.pub = es.pub WHERE cls <> 'NamedEntity'"),
    "cq5_shared_entities": (q.shared_entities, "SELECT e, key, count(DISTINCT pub) AS papers FROM entity JOIN entity_source USING (e) GROUP BY 1, 2 HAVING count(DISTINCT pub) > 1"),
    "cq6_related_papers": (q.related_papers, "SELECT a.pub AS p1, b.pub AS p2, x.doi, y.doi AS other_doi, count(DISTINCT a.e) AS shared FROM entity_source a JOIN entity_source b ON a.e = b.e AND a.pub <> b.pub LEFT JOIN source x ON x.pub = a.pub LEFT JOIN source y ON y.pub = b.pub GROUP BY 1, 2, 3, 4"),
    "cq7_mapped_across_papers": (q.mapped_across_papers, "SELECT term, count(DISTINCT pub) AS papers FROM mapping JOIN entity_source USING (e) WHERE tier IN ('exact', 'close', 'broad') AND term NOT LIKE 'https://graph.example/concept/%' GROUP BY 1 HAVING count(DISTINCT pub) > 1"),
    "cq8_mappings": (q.mappings, "SELECT DISTINCT e, key, tier, term FROM mapping JOIN entity USING (e) WHERE term NOT LIKE 'https://graph.example/concept/%'"),
    "cq9_decisions": (q.decisions, "SELECT DISTINCT key, d.dec, status, method, confidence, cand, mapping_rank, score_type, score_value FROM decision d JOIN entity USING (e) LEFT JOIN candidate c ON c.dec = d.dec"),
    "cq10_without_mapping": (q.without_mapping, f"SELECT DISTINCT e.e, cls, key, comment AS gap FROM entity e JOIN entity_class USING (e) WHERE cls <> 'NamedEntity' AND NOT EXISTS (SELECT 1 FROM resolved r JOIN {_EXTERNAL} x USING (c) WHERE r.e = e.e)"),
    "cq11_tier_distribution": (q.tier_distribution, f"SELECT acronym, tier, count(*) AS n FROM (SELECT DISTINCT e, term, tier, acronym FROM mapping JOIN {_EXTERNAL} x ON x.iri = term) GROUP BY 1, 2"),
    "cq12_claims_of": (q.claims_of, f"SELECT key, role, cause_key, effect_key, negated, hypothetical FROM (SELECT *, cause AS e, 'cause' AS role FROM {_CLAIMS} UNION ALL SELECT *, effect, 'effect' FROM {_CLAIMS} UNION ALL SELECT k.*, third, 'mediator' FROM {_CLAIMS} k JOIN causal_third t ON t.rel = k.rel AND t.role = 'mediator') JOIN entity USING (e)"),
    "cq13_chains": (q.chains, """WITH RECURSIVE walk AS (SELECT rel AS s, following AS o FROM next_relation UNION SELECT w.s, n.following FROM walk w JOIN next_relation n ON n.rel = w.o)
        SELECT m.chain, c.label AS chain_label, m.rel, count(DISTINCT CASE WHEN b.rel IS NOT NULL AND b.rel <> m.rel THEN b.rel END) AS position, x.key AS cause_key, y.key AS effect_key
        FROM chain_relation m JOIN chain c ON c.chain = m.chain JOIN causal k ON k.rel = m.rel JOIN entity x ON x.e = cause JOIN entity y ON y.e = effect
        LEFT JOIN walk w ON w.o = m.rel LEFT JOIN chain_relation b ON b.chain = m.chain AND b.rel = w.s GROUP BY 1, 2, 3, 5, 6"""),
    "cq14_estimates": (q.estimates, f"SELECT cause_key, effect_key, measure, value, p, n FROM {_CLAIMS} JOIN estimate USING (v)"),
    "cq15_opposed": (q.opposed, f"SELECT DISTINCT a.rel AS r1, b.rel AS r2, a.pub AS pub1, b.pub AS pub2, a.cause_key, a.effect_key FROM {_CLAIMS} a JOIN {_CLAIMS} b ON a.cause = b.cause AND a.effect = b.effect AND a.negated AND NOT b.negated AND a.pub <> b.pub"),
    "cq16_participants_of": (q.participants_of, f"SELECT s_key AS entity, o_key AS participant FROM {_edge('participant')} WHERE s IN (SELECT e FROM entity_class WHERE cls = 'Drug')"),
    "cq17_first_seen": (q.first_seen, f"SELECT e, key, min(year) AS first, count(DISTINCT pub) AS papers FROM entity JOIN entity_source USING (e) JOIN {_YEARS} USING (pub) GROUP BY 1, 2"),
    "cq18_term_years": (q.term_years, f"SELECT term, year, count(DISTINCT pub) AS papers FROM mapping JOIN entity_source USING (e) JOIN {_YEARS} USING (pub) WHERE tier IN ('exact', 'close') GROUP BY 1, 2"),
    "cq19_hypotheticality": (q.hypotheticality, f"SELECT k.pub, effect_key, year, doi, cause_key, hypothetical FROM {_CLAIMS} k JOIN {_YEARS} y USING (pub) LEFT JOIN source s ON s.pub = k.pub"),
    "cq20_validity": (q.validity, "SELECT rel, revision, valid_from, valid_until FROM causal_version"),
    "cq21_runs": (q.runs, "SELECT DISTINCT run, r.agent, cfg, run_id, started, ended, version AS agent_version, cfg_hash FROM run r LEFT JOIN agent a ON a.agent = r.agent"),
    "cq22_provenance_walk": (q.provenance_walk, f"SELECT DISTINCT k.e, m, dv, k.pub, key, surface, doi, run_id, a.label AS agent_label FROM {_MENTIONED} k JOIN entity USING (e) LEFT JOIN source s ON s.pub = k.pub LEFT JOIN snapshot x ON x.snapshot = k.snapshot LEFT JOIN run r ON r.run = x.run LEFT JOIN agent a ON a.agent = r.agent"),
    "cq23_classification_confidence": (q.classification_confidence, "SELECT surface, confidence FROM mention WHERE confidence IS NOT NULL"),
    "cq24_density": (q.density, f"SELECT k.pub, doi, count(DISTINCT e) AS entities, count(DISTINCT m) AS mentions FROM {_MENTIONED} k LEFT JOIN source s ON s.pub = k.pub GROUP BY 1, 2"),
    "cq24b_mention_reviews": (q.mention_reviews, "SELECT surface, dimension, status, r.confidence, version AS agent_version FROM mention_review JOIN mention USING (m) JOIN review r USING (rd) LEFT JOIN agent a ON a.agent = r.agent"),
    "cq25_cell_locations": (q.cell_locations, f"SELECT DISTINCT subject_key AS cell, object_key AS region, pub, doi, negated, modality, context, evidence FROM {_asserted('RO_0001025')} WHERE subject IN {_CELL}"),
    "cq26_containment": (q.containment, f"SELECT s_key AS part, o_key AS whole, x.curie AS part_term, y.curie AS whole_term FROM {_edge('part_of')} LEFT JOIN {_CURIES} x ON x.e = s LEFT JOIN {_CURIES} y ON y.e = o"),
    "cq26r_neighbours": (q.neighbours, "SELECT key, direction, predicate, other, l.label AS other_label FROM (SELECT s AS x, p AS predicate, o AS other, 'out' AS direction FROM triple UNION ALL SELECT o, p, s, 'in' FROM triple) JOIN entity k ON concat('e:', k.e) = x LEFT JOIN label l ON node = other"),
    "cq27_organisms": (q.organisms, f"SELECT DISTINCT es.pub, doi, cls AS kind, key FROM entity_class JOIN entity USING (e) JOIN entity_source es USING (e) LEFT JOIN source s ON s.pub = es.pub WHERE cls IN {_IN(q.ORGANISMS)}"),
    "cq28_carried": (q.carried, f"SELECT DISTINCT s_key AS line, o_key AS carries, cls AS carries_class FROM {_edge('participant')} JOIN entity_class c ON c.e = o WHERE cls <> 'NamedEntity' AND s IN (SELECT e FROM entity_class WHERE cls IN {_IN(q.LINES)})"),
    "cq29_method_participants": (q.method_participants, f"SELECT DISTINCT s_key AS method, o_key AS participant FROM {_edge('participant')} WHERE s IN (SELECT e FROM entity_class WHERE cls IN {_IN(q.METHODS)})"),
    "cq30_assay_chemicals": (q.assay_chemicals, f"SELECT DISTINCT p.s_key AS assay, p.o_key AS stimulus, b.o_key AS broader FROM {_edge('participant')} p LEFT JOIN {_edge('broader')} b ON b.s = p.o WHERE p.s IN (SELECT e FROM entity_class WHERE cls = 'Assay') AND p.o IN (SELECT e FROM entity_class WHERE cls IN {_IN(q.CHEMICALS)})"),
    "cq31_evidence_basis": (q.evidence_basis, f"SELECT cause_key, effect_key, hypothetical, basis, evidence FROM {_CLAIMS} k LEFT JOIN causal_basis b ON b.v = k.v"),
    "cq32_significant": (lambda t: q.estimates(t, 0.05), f"SELECT cause_key, effect_key, measure, value, p, n FROM {_CLAIMS} JOIN estimate USING (v) WHERE p < 0.05"),
    "cq33_third_variables": (q.third_variables, "SELECT x.key AS cause_key, y.key AS effect_key, role, z.key AS third_key FROM causal JOIN causal_third USING (rel) JOIN entity x ON x.e = cause JOIN entity y ON y.e = effect JOIN entity z ON z.e = third"),
    "cq34_cross_references": (q.cross_references, f"SELECT s_key AS a, x.curie AS a_term, o_key AS b, y.curie AS b_term FROM {_edge('see_also')} LEFT JOIN {_CURIES} x ON x.e = s LEFT JOIN {_CURIES} y ON y.e = o"),
    "cq35_derivations": (q.derivations, f"WITH RECURSIVE walk AS (SELECT s, o FROM edge WHERE p = 'derived_from' UNION SELECT w.s, n.o FROM walk w JOIN edge n ON n.s = w.o AND n.p = 'derived_from') SELECT DISTINCT x.key AS measure, y.key AS derived_from FROM walk JOIN entity x ON x.e = s JOIN entity y ON y.e = o WHERE s IN (SELECT e FROM entity_class WHERE cls IN {_IN(q.MEASUREMENTS)})"),
    "cq36_dependencies": (q.dependencies, f"SELECT s_key AS user_key, o_key AS uses, cls AS uses_class FROM {_edge('used')} JOIN entity_class c ON c.e = o WHERE cls <> 'NamedEntity'"),
    "cq37_broader": (q.broader, f"SELECT s_key AS child, o_key AS parent, curie AS parent_term FROM {_edge('broader')} LEFT JOIN {_CURIES} x ON x.e = o"),
    "cq38_unmapped_by_mentions": (q.unmapped_by_mentions, f"SELECT e.e, cls, key, count(DISTINCT m) AS mentions FROM entity e JOIN entity_class c ON c.e = e.e JOIN mention x ON x.e = e.e WHERE cls <> 'NamedEntity' AND e.e NOT IN (SELECT e FROM resolved JOIN {_EXTERNAL} USING (c)) GROUP BY 1, 2, 3"),
    "cq39_agreeing_claims": (q.agreeing_claims, f"SELECT cause_key, effect_key, polarity, negated, count(DISTINCT pub) AS papers, max(CASE WHEN hypothetical THEN 0 ELSE 1 END) AS any_non_hypothetical FROM {_CLAIMS} GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT pub) > 1"),
    "cq40_participations": (q.participations, f"SELECT s_key AS entity, o_key AS process FROM {_edge('participates_in')}"),
    "cq41_judges": (q.judges, "SELECT judge, version AS model, prompt, hash, mode FROM validation v LEFT JOIN agent a ON a.agent = v.agent WHERE v.agent IS NOT NULL AND judge LIKE 'judge:%'"),
    "cq42_entity_reviews": (q.entity_reviews, "SELECT key, dimension, status, confidence, r.comment AS reason FROM entity_review JOIN entity USING (e) JOIN review r USING (rd)"),
    "cq43_changes": (q.changes, f"SELECT kind, key, field, old, new, reason, licensed_by FROM change c LEFT JOIN entity e ON e.e = c.e WHERE kind IN {_IN(q.CHANGES)}"),
    "cq44_removed_mappings": (q.removed_mappings, "SELECT key, old AS removed_iri, reason FROM change c JOIN (SELECT cr, e FROM change WHERE e IS NOT NULL UNION ALL SELECT cr, e FROM entity_change) h ON h.cr = c.cr JOIN entity x ON x.e = h.e WHERE kind = 'MappingRemovedChange' AND old IS NOT NULL AND reason IS NOT NULL"),
    "cq45_mapping_sources": (q.mapping_sources, "SELECT source, method, count(DISTINCT dec) AS decisions FROM decision WHERE status = 'accepted' GROUP BY 1, 2"),
    "cq46_snapshot_summaries": (q.snapshot_summaries, "SELECT snapshot, label, summary, generated FROM snapshot"),
    "cq47_ontology_entities": (q.ontology_entities, "SELECT DISTINCT m.e, key, acronym, curie, c.label AS concept_label, tier FROM mapping m JOIN concept c ON c.iri = m.term JOIN resolved r ON r.e = m.e AND r.c = c.c JOIN entity x ON x.e = m.e"),
    "cq48_term_entities": (q.term_entities, "SELECT acronym, curie AS concept, string_agg(DISTINCT key, ', ' ORDER BY key) AS entities, count(DISTINCT pub) AS papers FROM resolved JOIN concept USING (c) JOIN entity USING (e) JOIN entity_source USING (e) GROUP BY 1, 2"),
    "cq49_ontology_coverage": (q.ontology_coverage, "SELECT acronym, count(DISTINCT e) AS entities, count(DISTINCT c) AS concepts FROM resolved JOIN concept USING (c) GROUP BY 1"),
    "cq50_phenotypes": (q.phenotypes, f"SELECT DISTINCT es.pub, cls AS level, key, doi FROM entity_class c JOIN entity USING (e) LEFT JOIN entity_source es ON es.e = c.e LEFT JOIN source s ON s.pub = es.pub WHERE cls IN {_PHENOTYPES}"),
    "cq51_phenotype_bearers": (q.phenotype_bearers, f"SELECT DISTINCT subject_key AS bearer, object_key AS phenotype, pub, doi, negated, modality, context, evidence FROM {_asserted('RO_0002200')}"),
    "cq52_phenotype_grounding": (q.phenotype_grounding, f"SELECT split_part(split_part(term, 'obo/', 2), '_', 1) AS vocab, tier, count(DISTINCT e) AS n FROM mapping WHERE term LIKE 'http://purl.obolibrary.org/obo/%' AND split_part(split_part(term, 'obo/', 2), '_', 1) IN ('HP', 'MP', 'PATO') AND e IN (SELECT e FROM entity_class WHERE cls IN {_PHENOTYPES}) GROUP BY 1, 2"),
    "cq53_phenotype_effects": (q.phenotype_effects, f"SELECT DISTINCT cause_key, effect_key AS phenotype, negated, hypothetical, measure, value FROM {_CLAIMS} k LEFT JOIN estimate s ON s.v = k.v WHERE effect IN (SELECT e FROM entity_class WHERE cls IN {_PHENOTYPES})"),
    "cq54_leaf_paths": (q.leaf_paths, f"WITH RECURSIVE walk AS (SELECT s, o FROM edge WHERE p = 'broader' UNION SELECT w.s, n.o FROM walk w JOIN edge n ON n.s = w.o AND n.p = 'broader') SELECT x.key AS leaf, y.key AS ancestor, curie AS ancestor_term FROM walk JOIN entity x ON x.e = s JOIN entity y ON y.e = o LEFT JOIN {_CURIES} z ON z.e = o WHERE s NOT IN (SELECT o FROM edge WHERE p = 'broader')"),
    "cq55_markers": (q.markers, f"SELECT DISTINCT subject_key AS cell, object_key AS marker, pub, doi, negated, modality, context, evidence FROM {_asserted('RO_0002292')}"),
    "cq58_cell_names": (q.cell_names, f"""SELECT k.key AS cell, any_value(k.label) AS label, string_agg(DISTINCT cls, ' | ' ORDER BY cls) AS classes, n.pub, any_value(doi) AS doi, any_value(title) AS title, string_agg(DISTINCT replace(surface, '  ', ' '), ' | ' ORDER BY replace(surface, '  ', ' ')) AS names, count(DISTINCT m) AS mentions,
        coalesce(string_agg(DISTINCT shown, ' ; ' ORDER BY shown), '') AS mappings, coalesce(string_agg(DISTINCT species, ' ; ' ORDER BY species), '') AS species
        FROM entity k JOIN entity_class c ON c.e = k.e JOIN {_MENTIONED} n ON n.e = k.e LEFT JOIN source s ON s.pub = n.pub
        LEFT JOIN (SELECT p.e, o.curie || ' "' || coalesce(o.label, '') || '" [' || tier || ']' || CASE WHEN term LIKE 'https://graph.example/concept/%' THEN ' (default, no external term)' ELSE '' END AS shown FROM mapping p JOIN concept o ON o.iri = p.term JOIN resolved r ON r.e = p.e AND r.c = o.c) g ON g.e = k.e
        LEFT JOIN (SELECT subject, a.pub, CASE WHEN o.curie IS NOT NULL THEN coalesce(o.label, z.key) || ' (' || o.curie || ')' ELSE z.key END AS species FROM assertion a JOIN entity z ON z.e = object LEFT JOIN (SELECT r.e, x.curie, x.label FROM resolved r JOIN concept x ON x.c = r.c WHERE curie LIKE 'NCBITaxon:%') o ON o.e = object WHERE predicate = 'RO_0002162' AND NOT negated) y ON y.subject = k.e AND y.pub = n.pub
        WHERE cls IN {_CELLS} GROUP BY k.key, n.pub"""),
    "cq59_cells_across_papers": (q.cells_across_papers, f"SELECT key AS cell, n.pub, doi, string_agg(DISTINCT replace(surface, '  ', ' '), ' | ' ORDER BY replace(surface, '  ', ' ')) AS names, paper_count FROM {_MENTIONED} n JOIN entity k ON k.e = n.e JOIN (SELECT e, count(DISTINCT pub) AS paper_count FROM {_MENTIONED} WHERE e IN {_CELL} GROUP BY 1 HAVING count(DISTINCT pub) > 1) w ON w.e = n.e LEFT JOIN source s ON s.pub = n.pub GROUP BY 1, 2, 3, 5"),
    "cq60_same_concept": (q.same_concept, f"""SELECT o.curie AS concept_id, o.label AS concept_label, string_agg(DISTINCT k.key || ' [' || tier || ']', ' ; ' ORDER BY k.key || ' [' || tier || ']') AS entities, string_agg(DISTINCT replace(surface, '  ', ' '), ' | ' ORDER BY replace(surface, '  ', ' ')) AS names, count(DISTINCT n.pub) AS papers
        FROM mapping p JOIN concept o ON o.iri = p.term JOIN resolved r ON r.e = p.e AND r.c = o.c JOIN entity k ON k.e = p.e JOIN {_MENTIONED} n ON n.e = p.e WHERE p.e IN {_CELL} AND term NOT LIKE 'https://graph.example/concept/%' GROUP BY 1, 2 HAVING count(DISTINCT n.pub) > 1"""),
    "cq61_characteristics": (q.characteristics, f"SELECT x.key AS cell, doi, CASE predicate WHEN 'RO_0002292' THEN 'expresses' WHEN 'RO_0001025' THEN 'located_in' WHEN 'RO_0002162' THEN 'in_taxon' WHEN 'RO_0002200' THEN 'has_phenotype' ELSE predicate END AS predicate, y.key AS object, negated, replace(evidence, '  ', ' ') AS evidence FROM assertion a JOIN entity x ON x.e = subject JOIN entity y ON y.e = object LEFT JOIN source s ON s.pub = a.pub WHERE negated IS NOT NULL AND subject IN {_CELL}"),
    "cq62_agreement": (q.agreement, f"SELECT x.key AS cell, predicate, y.key AS object, count(DISTINCT CASE WHEN NOT negated THEN pub END) AS papers_asserting, count(DISTINCT CASE WHEN negated THEN pub END) AS papers_negating, papers_naming FROM assertion a JOIN entity x ON x.e = subject JOIN entity y ON y.e = object JOIN (SELECT e, count(DISTINCT pub) AS papers_naming FROM {_MENTIONED} GROUP BY 1 HAVING count(DISTINCT pub) > 1) w ON w.e = subject WHERE negated IS NOT NULL AND subject IN {_CELL} GROUP BY 1, 2, 3, 6"),
    "cq63_same_meaning": (q.same_meaning, f"SELECT x.key AS cell_a, y.key AS cell_b, string_agg(DISTINCT a.predicate || ' ' || z.key, ' | ' ORDER BY a.predicate || ' ' || z.key) AS shared, count(DISTINCT a.predicate || ' ' || z.key) AS n_shared FROM assertion a JOIN assertion b ON a.predicate = b.predicate AND a.object = b.object AND a.subject < b.subject AND a.pub <> b.pub JOIN entity x ON x.e = a.subject JOIN entity y ON y.e = b.subject JOIN entity z ON z.e = a.object WHERE NOT a.negated AND NOT b.negated AND a.predicate <> 'RO_0002162' AND a.subject IN {_CELL} AND b.subject IN {_CELL} GROUP BY 1, 2 HAVING count(DISTINCT a.predicate || ' ' || z.key) >= 2"),
}


def _query(question):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return question(graph_of(spark, sf, TABLES))

    return run


QUERIES = {name: (_query(question), with_tables(body, TABLES)) for name, (question, body) in QUESTIONS.items()}
