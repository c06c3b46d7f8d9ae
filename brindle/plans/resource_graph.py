"""Competency questions over resources, and over reviews, asked of graphs that are made from the data's tables.

Customers are resources, orders their scopes and changes, lines their assumptions and statements; documents are a review's
publications, pages their full texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.graph import resources as q
from brindle.graph import reviews as g
from brindle.plans.entity_graph import graph_of, with_tables

TABLES = {
    "resource": """SELECT c_custkey AS r, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 1 END AS parent, CASE WHEN c_custkey % 4 = 0 THEN concat(c_nationkey % 3, '.0') END AS version,
        CASE c_nationkey % 6 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'superseded' WHEN 2 THEN 'withdrawn' WHEN 3 THEN 'active' END AS status, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 4 END AS superseded_by, CASE WHEN c_custkey % 2 = 0 THEN 'old' END AS reason,
        CASE WHEN c_custkey % 5 = 0 THEN 'move' END AS guidance, CASE WHEN c_custkey % 8 = 0 THEN c_custkey * 2 END AS generated_by FROM {customer}""",
    "resource_class": "SELECT c_custkey AS r, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Pipeline' WHEN 'MACHINERY' THEN 'Workflow' WHEN 'FURNITURE' THEN 'Dataset' WHEN 'HOUSEHOLD' THEN 'Atlas' ELSE 'SoftwareLibrary' END AS cls FROM {customer}",
    "scope": """SELECT o_orderkey AS scope, o_custkey AS r, CASE o_orderpriority WHEN '1-URGENT' THEN 'declared' WHEN '2-HIGH' THEN 'validated' WHEN '3-MEDIUM' THEN 'observed' WHEN '4-NOT SPECIFIED' THEN 'out' END AS kind, concat('NCBITaxon_', 9600 + o_orderkey % 10) AS taxon,
        CASE WHEN o_orderstatus <> 'P' THEN concat('level ', o_orderstatus) END AS evidence, CASE WHEN o_orderkey % 2 = 0 THEN concat('stated ', o_orderkey) END AS statement FROM {orders} WHERE o_custkey % 5 <> 0 AND o_orderkey % 3 = 0""",
    "scope_dimension": "SELECT scope, 'x/appliesToTaxon' AS dimension, CASE WHEN scope % 2 = 0 THEN 'taxon' END AS label, concat('http://x/', taxon) AS concept FROM {scope} UNION ALL SELECT scope, 'x/appliesToRegion', NULL, concat('region', scope % 5) FROM {scope} WHERE scope % 4 = 0",
    "assumption": """SELECT l_orderkey * 8 + l_linenumber AS a, l_suppkey AS r, concat('kind ', l_returnflag) AS type, CASE l_linenumber WHEN 1 THEN 'critical' WHEN 2 THEN 'major' WHEN 3 THEN 'minor' END AS criticality, CASE WHEN l_discount < 0.09 THEN concat('assumes ', l_partkey) END AS statement,
        CASE WHEN l_linestatus = 'O' THEN concat('breaks ', l_suppkey) END AS consequence, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS status FROM {lineitem}""",
    "violation": "SELECT l_orderkey * 8 + l_linenumber AS a, l_orderkey AS run FROM {lineitem} WHERE l_linenumber = 7",
    "project": "SELECT n_nationkey AS project, n_name AS label FROM {nation}",
    "produced": "SELECT c_custkey AS r, c_nationkey AS project FROM {customer} WHERE c_custkey % 2 = 0",
    "data_use": "SELECT c_custkey AS r, c_custkey * 2 AS duc, CASE WHEN c_custkey % 3 > 0 THEN concat('DUO_', c_custkey % 7) END AS permission, CASE WHEN c_custkey % 4 > 0 THEN concat('MOD_', c_custkey % 5) END AS modifier FROM {customer} WHERE c_custkey % 5 > 0 UNION ALL SELECT c_custkey, c_custkey * 2 + 1, 'DUO_9', NULL FROM {customer} WHERE c_custkey % 6 = 0",
    "resource_change": """SELECT o_orderkey AS change, o_custkey AS r, o_orderstatus = 'F' AS breaking, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'release' END AS trigger, CASE WHEN o_orderkey % 5 = 0 THEN 'schema' END AS reason,
        CASE WHEN o_orderkey % 6 > 0 THEN cast(o_orderdate AS date) END AS moment, CASE WHEN o_orderkey % 7 > 0 THEN concat('agent ', o_orderkey % 7) END AS agent FROM {orders}""",
    "record": "SELECT c_custkey AS rec, c_custkey AS r, CASE WHEN c_custkey % 2 = 0 THEN concat('1.', c_nationkey) END AS record_version, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS review, CASE WHEN c_custkey % 5 > 0 THEN concat('agent ', c_nationkey) END AS produced_by, CASE WHEN c_custkey % 6 > 0 THEN 2000 + c_nationkey END AS last_verified, CASE WHEN c_custkey % 7 > 0 THEN 2010 + c_nationkey END AS due, CASE WHEN c_custkey % 8 > 0 THEN c_acctbal END AS completeness FROM {customer}",
    "record_missing": "SELECT c_custkey AS rec, concat('field ', c_nationkey % 4) AS field FROM {customer} WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'field 9' FROM {customer} WHERE c_custkey % 6 = 0",
    "concept_mapping": "SELECT p_partkey AS m, CASE WHEN p_size > 5 THEN concat('field ', p_size) END AS field, CASE WHEN p_size % 2 = 0 THEN p_brand END AS concept, CASE WHEN p_size % 3 = 0 THEN 'exact' END AS relation, p_type AS status, CASE WHEN p_size % 5 > 0 THEN 'lexical' END AS method, CASE WHEN p_size % 7 = 0 THEN p_name END AS raw, p_retailprice AS confidence FROM {part}",
    "activity": "SELECT c_custkey * 2 AS act, CASE WHEN c_custkey % 3 > 0 THEN concat('activity ', c_custkey) END AS label FROM {customer}",
    "activity_input": "SELECT c_custkey * 2 AS act, cast((c_custkey - c_custkey % 2) / 2 AS bigint) AS r FROM {customer}",
    "activity_agent": "SELECT c_custkey * 2 AS act, concat('agent ', c_nationkey) AS agent FROM {customer} WHERE c_custkey % 5 > 0",
    "requirement": "SELECT o_custkey AS r, cast((o_orderkey - o_orderkey % 10) / 10 AS bigint) AS ref FROM {orders} WHERE o_orderkey % 2 = 0",
    "mentions": "SELECT o_custkey AS r, cast((o_orderkey - o_orderkey % 10) / 10 AS bigint) AS ref FROM {orders} WHERE o_orderkey % 3 = 0",
    "statement": "SELECT l_orderkey * 8 + l_linenumber AS a, l_suppkey AS r, concat('property ', l_linenumber) AS property, CASE WHEN l_returnflag <> 'A' THEN concat('NCBITaxon_', l_partkey % 50) END AS value, concat('model ', l_linenumber % 2) AS agent, l_linestatus = 'O' AS machine, CASE WHEN l_linenumber < 5 THEN concat('quote ', l_partkey) END AS quote, CASE WHEN l_linenumber < 3 THEN concat('sentence ', l_partkey) END AS sentence, CASE WHEN l_returnflag = 'R' THEN 'reviewed' END AS review FROM {lineitem}",
    "io": "SELECT p_partkey AS spec, p_partkey % 150 AS r, CASE WHEN p_partkey % 2 = 0 THEN 'input' ELSE 'output' END AS direction, CASE WHEN p_size < 45 THEN p_name END AS io_name, CASE WHEN p_size % 2 = 0 THEN p_type END AS format, CASE WHEN p_size % 3 = 0 THEN p_brand END AS modality, CASE WHEN p_size % 4 > 0 THEN p_size % 4 = 1 END AS required FROM {part}",
    "io_constraint": "SELECT p_partkey AS spec, concat('at most ', p_size) AS limits FROM {part} WHERE p_size % 5 = 0 UNION ALL SELECT p_partkey, 'not empty' FROM {part} WHERE p_size % 10 = 0",
    "failure": "SELECT o_orderkey AS f, o_custkey AS r, CASE WHEN o_orderkey % 9 > 0 THEN concat('fails ', o_orderkey) END AS statement, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS condition, CASE WHEN o_orderkey % 3 = 0 THEN 'noise' END AS symptom, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 = 1 END AS silent, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS severity, CASE WHEN o_orderkey % 6 = 0 THEN 'retry' END AS mitigation FROM {orders}",
    "referenced_by": "SELECT DISTINCT o_custkey AS r, o_orderkey % 40 AS work FROM {orders}",
    "work": "SELECT doc_id AS work, CASE WHEN doc_id % 3 > 0 THEN concat('Work ', doc_id) END AS title, CASE WHEN doc_id % 2 = 0 THEN concat('10.5555/w', doc_id) END AS doi FROM {documents}",
    "attested_at": "SELECT o_custkey AS r, o_orderkey % 120 AS loc FROM {orders} WHERE o_orderkey % 2 = 0",
    "locator": "SELECT doc_id AS loc, doc_id % 40 AS work, CASE WHEN doc_id % 5 > 0 THEN concat('page ', doc_id) END AS place FROM {documents}",
    "release": "SELECT c_custkey AS r, CASE WHEN c_custkey % 5 > 0 THEN concat('2.', c_nationkey) END AS version, CASE WHEN c_custkey % 3 > 0 THEN 2000 + c_nationkey END AS released FROM {customer}",
    "observation": "SELECT event_id AS o, user_id AS r, cast(ts AS date) AS moment, event_type AS property, cast(cast(floor(value) AS bigint) AS string) AS value, CASE WHEN event_id % 2 = 0 THEN 'log' END AS source FROM {events}",
    "resolution": "SELECT p_partkey AS a, concat('id:', p_partkey) AS identifier, CASE WHEN p_size % 3 > 0 THEN 'resolved' ELSE 'failed' END AS status, p_type AS route, CASE WHEN p_size % 2 = 0 THEN p_brand END AS source, CASE WHEN p_size % 4 > 0 THEN 2000 + p_size END AS moment FROM {part}",
    "verification": "SELECT p_partkey AS v, p_partkey % 150 AS r, CASE WHEN p_size % 4 = 0 THEN 'mismatch' ELSE 'match' END AS outcome, p_type AS asserted, p_brand AS actual, CASE WHEN p_size % 3 = 0 THEN p_name END AS source, CASE WHEN p_size % 5 > 0 THEN 1990 + p_size END AS moment FROM {part}",
}

_PARENT = "resource r LEFT JOIN resource u ON u.r = r.parent"
_NAMES = f"(SELECT r.r, coalesce(r.name, u.name, 'ex:' || r.r) || CASE WHEN r.version IS NOT NULL THEN ' v' || r.version ELSE '' END AS shown FROM {_PARENT})"
_NAMED = "(SELECT r, name AS resource FROM resource WHERE name IS NOT NULL)"

QUESTIONS = {
    "bkr_cq01_of_taxon": (lambda t: q.of_taxon(t, "NCBITaxon_9606"), f"SELECT DISTINCT shown AS name, CASE kind WHEN 'observed' THEN 'observed in use' WHEN 'out' THEN 'out of scope' ELSE coalesce(kind, 'recovered from text') END AS claim, evidence FROM scope JOIN {_NAMES} USING (r) WHERE taxon = 'NCBITaxon_9606'"),
    "bkr_cq02_taxa": (q.taxa, f"SELECT shown AS name, CASE kind WHEN 'declared' THEN '1 declared' WHEN 'validated' THEN '2 validated' WHEN 'observed' THEN '3 observed in use' ELSE '4 out of scope' END AS claim, string_agg(DISTINCT taxon, ', ' ORDER BY taxon) AS taxa FROM scope JOIN {_NAMES} USING (r) WHERE kind IS NOT NULL GROUP BY 1, 2"),
    "bkr_cq03_beyond_declared": (q.beyond_declared, f"SELECT DISTINCT shown AS name, taxon AS off_taxon, statement FROM scope s JOIN {_NAMES} n ON n.r = s.r WHERE kind = 'observed' AND NOT EXISTS (SELECT 1 FROM scope d WHERE d.kind = 'declared' AND d.r = s.r AND d.taxon = s.taxon)"),
    "bkr_cq04_critical_assumptions": (q.critical_assumptions, f"SELECT resource, type AS assumption_type, statement, consequence, status FROM assumption JOIN {_NAMED} USING (r) WHERE criticality = 'critical' AND statement IS NOT NULL"),
    "bkr_cq05_violated": (q.violated, "SELECT run, statement, consequence, criticality FROM violation v JOIN assumption a ON a.a = v.a WHERE statement IS NOT NULL"),
    "bkr_cq06_outputs": (q.outputs, f"SELECT label AS project, shown AS name, string_agg(DISTINCT coalesce(permission, ''), ', ' ORDER BY coalesce(permission, '')) AS permissions, string_agg(DISTINCT coalesce(modifier, ''), ', ' ORDER BY coalesce(modifier, '')) AS modifiers FROM produced p JOIN project j ON j.project = p.project JOIN {_NAMES} n ON n.r = p.r LEFT JOIN (SELECT r, permission, modifier FROM data_use UNION ALL SELECT c.r, permission, modifier FROM data_use d JOIN resource c ON c.parent = d.r) d ON d.r = p.r GROUP BY 1, 2"),
    "bkr_cq07_past": (q.past, f"SELECT shown AS name, x.status, coalesce(o.name, 'version ' || o.version, 'ex:' || o.r) AS replacement, x.reason, x.guidance FROM resource x JOIN {_NAMES} n ON n.r = x.r LEFT JOIN resource o ON o.r = x.superseded_by WHERE x.status IN ('deprecated', 'superseded', 'withdrawn')"),
    "bkr_cq08_breaking_changes": (q.breaking_changes, f"SELECT shown AS affected, kind AS change_type, trigger, reason, moment, agent FROM resource_change JOIN {_NAMES} USING (r) WHERE breaking"),
    "bkr_cq09_record_states": (q.record_states, "SELECT name AS resource, record_version, review, produced_by, last_verified, due FROM record c LEFT JOIN resource x ON x.r = c.r"),
    "bkr_cq10_mapping_audit": (q.mapping_audit, "SELECT field, concept, relation, status, method, raw, confidence FROM concept_mapping"),
    "bkr_cq11_version_provenance": (lambda t: q.version_provenance(t, "Customer#0000000"), "SELECT v.version, 'act:' || v.generated_by AS activity, CASE WHEN i.act IS NOT NULL THEN coalesce(n.name, 'ex:' || i.r) END AS input, agent FROM resource v JOIN resource d ON d.r = v.parent AND d.name LIKE '%Customer#0000000%' LEFT JOIN activity_input i ON i.act = v.generated_by LEFT JOIN resource n ON n.r = i.r LEFT JOIN activity_agent a ON a.act = v.generated_by WHERE v.version IS NOT NULL AND v.generated_by IS NOT NULL"),
    "bkr_cq12_dependents": (lambda t: q.dependents(t, "2.0", "Customer#0000000"), f"WITH ref AS (SELECT r.r AS id, coalesce(r.name, u.name) AS reference FROM {_PARENT} WHERE r.version = '2.0' AND lower(coalesce(r.name, u.name)) LIKE '%customer#0000000%') SELECT DISTINCT reference, dependent, relation FROM (SELECT reference, resource AS dependent, 'requires as reference' AS relation FROM ref JOIN requirement m ON m.ref = id JOIN {_NAMED} n ON n.r = m.r UNION ALL SELECT reference, coalesce(label, 'act:' || i.act), 'used in activity' FROM ref JOIN activity_input i ON i.r = id LEFT JOIN activity a ON a.act = i.act UNION ALL SELECT reference, resource, 'mentions' FROM ref JOIN mentions m ON m.ref = id JOIN {_NAMED} n ON n.r = m.r)"),
    "bkr_cq13_scope_gaps": (q.scope_gaps, f"SELECT DISTINCT shown AS name, cls AS class FROM resource_class c JOIN resource x ON x.r = c.r JOIN {_NAMES} n ON n.r = c.r WHERE cls IN ('Pipeline', 'Workflow', 'Atlas', 'SoftwareLibrary') AND c.r NOT IN (SELECT r FROM scope) AND coalesce(x.parent, -1) NOT IN (SELECT r FROM scope)"),
    "bkr_cq14_coverage": (q.coverage, "SELECT coalesce(d.label, split_part(dimension, 'appliesTo', 2)) AS dimension, CASE WHEN concept LIKE '%/%' THEN split_part(concept, '/', -1) ELSE concept END AS concept, count(DISTINCT r) AS resources FROM scope_dimension d JOIN scope s ON s.scope = d.scope GROUP BY 1, 2"),
    "bkr_cq15_machine_statements": (q.machine_statements, "SELECT coalesce(name, 'ex:' || s.r) AS subject, property, value, quote, sentence, agent, review FROM statement s LEFT JOIN resource x ON x.r = s.r WHERE machine"),
    "bkr_cq16_interfaces": (q.interfaces, f"SELECT resource, direction, io_name AS io, format, modality, required, limits FROM io JOIN {_NAMED} USING (r) LEFT JOIN io_constraint c ON c.spec = io.spec WHERE io_name IS NOT NULL"),
    "bkr_cq17_failure_modes": (q.failure_modes, f"SELECT resource, statement, condition, symptom, silent, severity, mitigation FROM failure JOIN {_NAMED} USING (r) WHERE statement IS NOT NULL"),
    "bkr_cq18_completeness": (q.completeness, f"SELECT resource, completeness, review AS review_status, string_agg(DISTINCT coalesce(field, ''), ', ' ORDER BY coalesce(field, '')) AS not_found FROM record c JOIN {_NAMED} USING (r) LEFT JOIN record_missing m ON m.rec = c.rec GROUP BY 1, 2, 3"),
    "bkr_cq19_attesting_works": (q.attesting_works, f"SELECT resource, coalesce(title, 'work:' || b.work) AS work, doi, string_agg(DISTINCT coalesce(place, ''), ', ' ORDER BY coalesce(place, '')) AS locations FROM referenced_by b JOIN {_NAMED} USING (r) LEFT JOIN work w ON w.work = b.work LEFT JOIN (SELECT r, work AS at_work, place FROM attested_at JOIN locator USING (loc) WHERE place IS NOT NULL) p ON p.r = b.r AND at_work = b.work GROUP BY 1, 2, 3"),
    "bkr_cq20_timeline": (q.timeline, f"""SELECT resource, coalesce(released::VARCHAR, '') AS "when", 'version' AS kind, version AS what, '' AS source FROM release JOIN {_NAMED} USING (r) WHERE version IS NOT NULL UNION ALL SELECT resource, coalesce(moment::VARCHAR, ''), 'change', coalesce(kind, 'change'), '' FROM resource_change JOIN {_NAMED} USING (r)
        UNION ALL SELECT resource, coalesce(moment::VARCHAR, ''), 'observation', property || ' = ' || value, coalesce(source, '') FROM observation JOIN {_NAMED} USING (r)"""),
    "bkr_cq21_problems": (q.problems, f"""SELECT 'unresolved identifier' AS problem, identifier AS subject, status || ' via ' || route AS detail, coalesce(source, '') AS source, coalesce(moment::VARCHAR, '') AS "when" FROM resolution WHERE status <> 'resolved'
        UNION ALL SELECT 'metadata mismatch', resource, 'extracted ' || asserted || ' but source gives ' || actual, coalesce(source, ''), coalesce(moment::VARCHAR, '') FROM verification JOIN {_NAMED} USING (r) WHERE outcome = 'mismatch'"""),
}

REVIEW_TABLES = {
    "included": "SELECT source AS review, doc_id AS pub FROM {documents} WHERE doc_id % 3 > 0 UNION ALL SELECT 'second', doc_id FROM {documents} WHERE doc_id % 30 = 1",
    "publication": "SELECT doc_id AS pub, CASE WHEN doc_id % 17 > 0 THEN concat('Title ', doc_id % 50) END AS title, CASE WHEN doc_id % 4 > 0 THEN concat('10.5555/d', doc_id) END AS doi, CASE WHEN doc_id % 5 > 0 THEN doc_id + 1000 END AS pmid, CASE WHEN doc_id % 6 > 0 THEN substr(text, 1, 40) END AS abstract FROM {documents}",
    "artifact": "SELECT page_id AS art, page_id * 2 AS pub, CASE WHEN page_id % 9 > 0 THEN html END AS content, CASE WHEN page_id % 5 > 0 THEN length(html) END AS bytes, CASE WHEN page_id % 4 > 0 THEN md5(html) END AS hash, CASE WHEN page_id % 3 > 0 THEN 'text/html' END AS media, CASE page_id % 4 WHEN 0 THEN 'publisher' WHEN 1 THEN 'repository' WHEN 2 THEN 'library_proxy' END AS source, CASE WHEN page_id % 2 = 0 THEN 2000 + page_id % 20 END AS created, CASE WHEN page_id % 5 < 4 THEN page_id * 3 END AS act, CASE WHEN page_id % 7 > 0 THEN url END AS derived_from FROM {pages}",
    "activity": "SELECT page_id * 3 AS act, CASE WHEN page_id % 2 = 0 THEN 'fetcher' END AS tool, CASE WHEN page_id % 3 > 0 THEN 2010 + page_id % 9 END AS ended, CASE WHEN page_id % 4 > 0 THEN md5(url) END AS result_hash FROM {pages} WHERE page_id % 8 > 0",
    "reading": "SELECT source AS review, count(*) AS retrieved, CASE WHEN count(*) % 2 = 0 THEN min(doc_id) END AS not_retrieved, max(doc_id) AS on_full_text, CASE WHEN count(*) % 3 > 0 THEN 7 END AS on_abstract_only, min(n_chars) AS included_full, max(n_chars) AS included_abstract FROM {documents} GROUP BY source",
    "route": "SELECT source AS review, lang AS source, count(*) AS reports FROM {documents} GROUP BY source, lang",
    "exclusion": "SELECT source AS review, CASE WHEN doc_id % 3 = 0 THEN 'title_abstract' WHEN doc_id % 3 = 1 THEN 'eligibility' ELSE 'other' END AS stage, lang AS reason, count(*) AS reports FROM {documents} GROUP BY source, lang, CASE WHEN doc_id % 3 = 0 THEN 'title_abstract' WHEN doc_id % 3 = 1 THEN 'eligibility' ELSE 'other' END",
    "screening": "SELECT doc_id AS rec, source AS review, CASE WHEN doc_id % 2 = 0 THEN 'full_text' ELSE 'title_abstract' END AS stage, CASE doc_id % 3 WHEN 0 THEN 'Include' WHEN 1 THEN 'include' ELSE 'exclude' END AS decision, CASE WHEN doc_id % 4 < 2 THEN 'abstract_only' ELSE 'full_text' END AS assessed_on, CASE WHEN doc_id % 5 > 0 THEN doc_id + 1000 END AS pmid, CASE WHEN doc_id % 6 > 0 THEN lang END AS source, CASE WHEN doc_id % 7 > 0 THEN concat('reason ', doc_id % 7) END AS reason FROM {documents}",
    "question": "SELECT item_id AS q, CASE WHEN item_id % 6 > 0 THEN concat('RQ', item_id % 8) END AS qid, CASE WHEN item_id % 5 > 0 THEN concat('Question ', item_id % 8) END AS title FROM {benchmark}",
    "answer": "SELECT doc_id AS a, doc_id % 30 AS q, CASE WHEN doc_id % 11 > 0 THEN substr(text, 1, 30) END AS text, CASE WHEN doc_id % 3 > 0 THEN source END AS source_id, CASE WHEN doc_id % 4 > 0 THEN doc_id END AS pub FROM {documents}",
}

_SOURCES = "(SELECT * FROM publication WHERE title IS NOT NULL AND pub IN (SELECT pub FROM included))"
_ARTIFACTS = "(SELECT p.title, p.doi, a.* FROM publication p JOIN artifact a ON a.pub = p.pub WHERE p.pub IN (SELECT pub FROM included))"

REVIEW_QUESTIONS = {
    "review_full_texts": (g.full_texts, f"SELECT DISTINCT s.pub, title, doi, pmid, bytes, hash, content AS text FROM {_SOURCES} s JOIN artifact a ON a.pub = s.pub WHERE content IS NOT NULL"),
    "review_full_texts_brief": (lambda t: g.full_texts(t, content=False), f"SELECT DISTINCT s.pub, title, doi, pmid, bytes, hash FROM {_SOURCES} s JOIN artifact a ON a.pub = s.pub"),
    "review_abstracts_only": (g.abstracts_only, f"SELECT DISTINCT pub, title, doi, abstract FROM {_SOURCES} s WHERE NOT EXISTS (SELECT 1 FROM artifact a WHERE a.pub = s.pub)"),
    "review_statuses": (g.statuses, "SELECT title, CASE WHEN art IS NOT NULL THEN 'full_text' ELSE 'abstract_only' END AS status, doi, bytes FROM included i JOIN publication p ON p.pub = i.pub LEFT JOIN artifact a ON a.pub = i.pub WHERE title IS NOT NULL"),
    "review_counts": (g.counts, "SELECT count(DISTINCT i.pub) AS included, count(DISTINCT a.pub) AS full_text, count(DISTINCT i.pub) - count(DISTINCT a.pub) AS abstract_only FROM included i LEFT JOIN artifact a ON a.pub = i.pub"),
    "review_provenance": (g.provenance, f"SELECT title, source, hash, bytes, media FROM {_ARTIFACTS} WHERE title IS NOT NULL"),
    "review_source_counts": (g.source_counts, f"SELECT coalesce(source, '(unknown)') AS source, count(art) AS n FROM {_ARTIFACTS} GROUP BY 1"),
    "review_retrieval_chain": (g.retrieval_chain, f'SELECT title, tool AS source, ended AS "when", result_hash AS hash FROM {_ARTIFACTS} JOIN activity USING (act) WHERE title IS NOT NULL AND derived_from IS NOT NULL'),
    "review_reading_basis": (g.reading_basis, "SELECT retrieved, not_retrieved, on_full_text, on_abstract_only, included_full, included_abstract FROM reading"),
    "review_routes": (g.routes, "SELECT source AS route, reports FROM route"),
    "review_route_articles": (lambda t: g.route_articles(t, "library_proxy"), f"SELECT title, doi, created AS \"when\" FROM {_ARTIFACTS} WHERE source = 'library_proxy'"),
    "review_exclusions": (g.exclusions, "SELECT stage, reason, reports FROM exclusion WHERE stage <> 'other'"),
    "review_decisions": (g.decisions, "SELECT pmid, stage, decision, assessed_on, source AS route, reason FROM screening"),
    "review_abstract_inclusions": (g.abstract_inclusions, "SELECT pmid, reason FROM screening WHERE stage = 'full_text' AND assessed_on = 'abstract_only' AND decision ILIKE 'include'"),
    "review_question_counts": (g.question_counts, "SELECT qid, title, count(a) AS answers FROM answer JOIN question USING (q) GROUP BY 1, 2"),
    "review_answers": (lambda t: g.answers(t, "RQ1"), "SELECT pmid, source_id, a.text AS answer FROM question JOIN answer a USING (q) LEFT JOIN publication p ON p.pub = a.pub WHERE qid = 'RQ1' AND a.text IS NOT NULL"),
}


def _query(question, specs: dict[str, str]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return question(graph_of(spark, sf, specs))

    return run


QUERIES = {name: (_query(question, TABLES), with_tables(body, TABLES)) for name, (question, body) in QUESTIONS.items()}
QUERIES |= {name: (_query(question, REVIEW_TABLES), with_tables(body, REVIEW_TABLES)) for name, (question, body) in REVIEW_QUESTIONS.items()}
