"""Records, graphs and tables made from the order tables: merged, redirected, entailed, validated, compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import records as r
from brindle.sources.tables import read


def merged_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of one resource as one, and numbered ids of repeats."""
    rows = read(spark, sf, "orders").selectExpr("o_custkey AS key", "o_orderkey AS position", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS a", "CASE WHEN o_orderkey % 50 = 0 THEN o_orderstatus END AS b", "array(o_orderstatus, substring(o_orderpriority, 1, 1)) AS tags")
    found = r.merged(rows, "key", ["a", "b"], ["tags"])
    return found.select("key", "a", "b", F.array_join("tags", ",").alias("tags"), "missing")


MERGED = """
WITH o AS (SELECT o_custkey AS key, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS a, CASE WHEN o_orderkey % 50 = 0 THEN o_orderstatus END AS b, o_orderstatus, o_orderpriority FROM orders),
t AS (SELECT key, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM (SELECT key, o_orderstatus AS t FROM o UNION SELECT key, left(o_orderpriority, 1) FROM o) GROUP BY 1), m AS (SELECT key, arg_min(a, o_orderkey) FILTER (a IS NOT NULL) AS a, arg_min(b, o_orderkey) FILTER (b IS NOT NULL) AS b FROM o GROUP BY 1)
SELECT key, a, b, tags, concat_ws(',', CASE WHEN a IS NULL THEN 'a' END, CASE WHEN b IS NULL THEN 'b' END) AS missing FROM m JOIN t USING (key)
"""


def redirected_graph(spark: SparkSession, sf: str) -> DataFrame:
    """A graph with mention stubs replaced by the resources that their most specific key names."""
    stubs = read(spark, sf, "customer").where("c_custkey % 2 = 0").selectExpr("concat('c', c_custkey) AS stub", "explode(array(named_struct('key', concat('id', c_custkey), 'place', 0), named_struct('key', concat('seg', c_mktsegment), 'place', 2), named_struct('key', concat('nat', c_nationkey), 'place', 1))) AS x").select("stub", "x.key", "x.place")
    resources = read(spark, sf, "supplier").selectExpr("concat('s', s_suppkey) AS resource", "explode(array(concat('id', s_suppkey * 4), concat('nat', s_nationkey))) AS key")
    triples = read(spark, sf, "orders").selectExpr("concat('c', o_custkey) AS s", "o_orderstatus AS p", "concat('c', o_orderkey % 100) AS o")
    return r.redirected(triples, r.stub_targets(stubs, resources))


REDIRECTED = """
WITH k AS (SELECT 'id' || s_suppkey * 4 AS key, 's' || s_suppkey AS r FROM supplier UNION SELECT 'nat' || s_nationkey, 's' || s_suppkey FROM supplier), u AS (SELECT key, min(r) AS r FROM k GROUP BY 1 HAVING count(DISTINCT r) = 1),
t AS (SELECT 'c' || c_custkey AS stub, coalesce(a.r, b.r) AS target FROM customer LEFT JOIN u a ON a.key = 'id' || c_custkey LEFT JOIN u b ON b.key = 'nat' || c_nationkey WHERE c_custkey % 2 = 0 AND coalesce(a.r, b.r) IS NOT NULL)
SELECT DISTINCT coalesce(x.target, 'c' || o_custkey) AS s, o_orderstatus AS p, coalesce(y.target, 'c' || o_orderkey % 100) AS o FROM orders LEFT JOIN t x ON x.stub = 'c' || o_custkey LEFT JOIN t y ON y.stub = 'c' || o_orderkey % 100
"""


def bag_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that are missing or surplus in a delivery, with how often."""
    lines = read(spark, sf, "lineitem")
    return r.bag_difference(lines.where("l_linenumber <> 3").select("l_suppkey", "l_returnflag"), lines.where("l_linenumber <> 5").select("l_suppkey", "l_returnflag"))


BAG = "SELECT l_suppkey, l_returnflag, CASE WHEN sum(d) > 0 THEN 'missing' ELSE 'surplus' END AS side, abs(sum(d))::BIGINT AS n FROM (SELECT l_suppkey, l_returnflag, CASE l_linenumber WHEN 5 THEN 1 WHEN 3 THEN -1 END AS d FROM lineitem WHERE l_linenumber IN (3, 5)) GROUP BY 1, 2 HAVING sum(d) <> 0"


def _schema(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Nation", "subClassOf", "Place"), ("Place", "subClassOf", "Thing"), ("Buyer", "subClassOf", "Agent"), ("Agent", "equivalentClass", "Actor"), ("livesIn", "subPropertyOf", "locatedIn"), ("livesIn", "domain", "Buyer"), ("locatedIn", "range", "Place"), ("houses", "inverseOf", "livesIn")], "s string, p string, o string")


def entailed_graph(spark: SparkSession, sf: str) -> DataFrame:
    """What a small ontology entails of customers and nations."""
    own = read(spark, sf, "customer").selectExpr("concat('c', c_custkey) AS s", "CASE WHEN c_custkey % 3 = 0 THEN 'livesIn' ELSE 'knows' END AS p", "concat('n', c_nationkey) AS o")
    housed = read(spark, sf, "nation").selectExpr("concat('n', n_nationkey) AS s", "'houses' AS p", "concat('c', n_nationkey) AS o")
    return r.entailed(_schema(spark).unionByName(own).unionByName(housed))


ENTAILED = """
WITH d AS (SELECT 'c' || c_custkey AS s, CASE WHEN c_custkey % 3 = 0 THEN 'livesIn' ELSE 'knows' END AS p, 'n' || c_nationkey AS o FROM customer UNION SELECT 'n' || n_nationkey, 'houses', 'c' || n_nationkey FROM nation),
l AS (SELECT s, o FROM d WHERE p = 'livesIn' UNION SELECT o, s FROM d WHERE p = 'houses')
SELECT s, p, o FROM d UNION SELECT s, 'livesIn', o FROM l UNION SELECT s, 'locatedIn', o FROM l UNION SELECT o, 'houses', s FROM l UNION SELECT s, 'type', unnest(['Buyer', 'Agent', 'Actor']) FROM l UNION SELECT o, 'type', unnest(['Place', 'Thing']) FROM l
"""


def graph_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations and types that a graph's schema does not allow."""
    schema = _schema(spark).where("p in ('subClassOf', 'domain', 'range')")
    customers = read(spark, sf, "customer")
    own = customers.selectExpr("concat('c', c_custkey) AS s", "CASE c_custkey % 3 WHEN 0 THEN 'livesIn' WHEN 1 THEN 'locatedIn' ELSE 'knows' END AS p", "concat('n', c_nationkey) AS o")
    types = customers.where("c_custkey % 4 > 0").selectExpr("concat('c', c_custkey) AS s", "'type' AS p", "CASE WHEN c_custkey % 2 = 0 THEN 'Buyer' ELSE 'Seller' END AS o").unionByName(read(spark, sf, "nation").where("n_nationkey % 2 = 0").selectExpr("concat('n', n_nationkey) AS s", "'type' AS p", "CASE WHEN n_nationkey % 4 = 0 THEN 'Nation' ELSE 'Place' END AS o"))
    return r.graph_violations(schema.unionByName(own).unionByName(types))


GRAPH_RULES = """
WITH c AS (SELECT 'c' || c_custkey AS s, c_custkey % 3 AS k, c_custkey % 4 AS t, c_custkey, c_nationkey FROM customer)
SELECT DISTINCT s, 'unknown relation knows' AS rule FROM c WHERE k = 2 UNION SELECT s, 'domain of livesIn' FROM c WHERE k = 0 AND t NOT IN (2) UNION SELECT s, 'range of locatedIn' FROM c WHERE k = 1 AND c_nationkey % 2 = 1 UNION SELECT s, 'no type' FROM c WHERE t = 0
"""


def nested_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities with their mentions and mappings within them."""
    parts = read(spark, sf, "part")
    lines = read(spark, sf, "lineitem").selectExpr("l_partkey AS e", "l_orderkey AS start", "l_returnflag AS surface")
    terms = parts.where("p_size % 3 > 0").selectExpr("p_partkey AS e", "CASE p_size % 3 WHEN 1 THEN 'exact' ELSE 'close' END AS tier", "p_brand AS term")
    found = r.nested(parts.selectExpr("p_partkey AS e", "p_name AS label"), lines, terms)
    return found.select("e", "label", F.coalesce(F.size("mentions"), F.lit(0)).alias("n"), F.md5(F.coalesce(F.array_join(F.transform("mentions", lambda x: F.concat_ws("/", x["start"].cast("string"), x["surface"])), ","), F.lit(""))).alias("mentions"), F.coalesce(F.array_join(F.transform("mappings", lambda x: F.concat_ws(":", x["tier"], x["term"])), ","), F.lit("")).alias("mappings"))


NESTED = """
SELECT p_partkey AS e, p_name AS label, coalesce(n, 0) AS n, md5(coalesce(m, '')) AS mentions, CASE p_size % 3 WHEN 1 THEN 'exact:' || p_brand WHEN 2 THEN 'close:' || p_brand ELSE '' END AS mappings
FROM part LEFT JOIN (SELECT l_partkey, count(*)::INTEGER AS n, string_agg(l_orderkey || '/' || l_returnflag, ',' ORDER BY l_orderkey, l_returnflag) AS m FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
"""


def observed_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Checks added to a graph as nodes of their own; those of an earlier run stay as they were."""
    old = spark.createDataFrame([("check/r0/1", "signal", "old"), ("x", "p", "y")], "s string, p string, o string")
    checks = read(spark, sf, "events").groupBy((F.col("user_id") % 3).cast("string").alias("subject"), F.concat(F.lit("r"), (F.col("event_id") % 2).cast("string")).alias("run")).agg(F.max("event_type").alias("signal"))
    return r.observed(old, checks)


OBSERVED = """
WITH c AS (SELECT (user_id % 3)::VARCHAR AS subject, 'r' || event_id % 2 AS run, max(event_type) AS signal FROM events GROUP BY 1, 2), n AS (SELECT 'check/' || run || '/' || subject AS s, * FROM c)
SELECT 'check/r0/1' AS s, 'signal' AS p, 'old' AS o UNION SELECT 'x', 'p', 'y' UNION SELECT s, 'of', subject FROM n WHERE s <> 'check/r0/1' UNION SELECT s, 'signal', signal FROM n WHERE s <> 'check/r0/1' UNION SELECT s, 'run', run FROM n WHERE s <> 'check/r0/1'
"""


def resource_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """The status of resources from their signals."""
    rows = read(spark, sf, "orders").selectExpr("o_custkey AS subject", "CASE o_orderkey % 40 WHEN 0 THEN 'archived' WHEN 1 THEN 'deprecated' WHEN 2 THEN 'inactive' WHEN 3 THEN 'unavailable' ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'dated' ELSE 'other' END END AS kind", "o_orderkey % 3000 + 200 AS age")
    return r.resource_status(rows)


STATUS = """
WITH s AS (SELECT o_custkey AS subject, CASE o_orderkey % 40 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS k, CASE WHEN o_orderkey % 40 > 3 AND o_orderkey % 4 = 0 THEN o_orderkey % 3000 + 200 END AS age FROM orders)
SELECT subject, CASE min(k) WHEN 0 THEN 'archived' WHEN 1 THEN 'deprecated' WHEN 2 THEN 'inactive' WHEN 3 THEN 'unavailable' ELSE CASE WHEN min(age) <= 365 THEN 'active' WHEN min(age) <= 1095 THEN 'stale' WHEN min(age) IS NOT NULL THEN 'inactive' ELSE 'unknown' END END AS status FROM s GROUP BY 1
"""


def wave_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Variables that are one measure at several waves."""
    rows = read(spark, sf, "part").selectExpr("p_partkey AS variable", "p_size % 20 AS paper", "p_name AS stripped", "array(p_name, CASE WHEN p_partkey % 3 = 0 THEN 'red ring' ELSE 'x' END) AS wordings", "CASE WHEN p_partkey % 5 = 0 THEN 'change' END AS derivation", "CASE WHEN p_partkey % 4 = 0 THEN p_type END AS resolved")
    return r.wave_measures(rows)


MEASURES = """
WITH RECURSIVE v AS (SELECT p_partkey AS v, p_size % 20 AS paper, p_name AS k, [p_name, CASE WHEN p_partkey % 3 = 0 THEN 'red ring' ELSE 'x' END] AS w, CASE WHEN p_partkey % 5 = 0 THEN 'change' END AS d, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS r FROM part),
e AS (SELECT DISTINCT a.v AS s, b.v AS o FROM v a JOIN v b ON a.paper = b.paper AND list_contains(b.w, a.k) AND a.v <> b.v AND a.d IS NOT DISTINCT FROM b.d AND (a.r IS NULL OR b.r IS NULL OR a.r = b.r)), b AS (SELECT s, o FROM e UNION SELECT o, s FROM e),
c AS (SELECT v AS s, v AS o FROM v UNION SELECT c.s, b.o FROM c JOIN b ON b.s = c.o) SELECT s AS variable, min(o) AS measure FROM c GROUP BY 1
"""


def taxon_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes by any of their identifiers, and whether they cover a species."""
    taxa = read(spark, sf, "supplier").selectExpr("s_suppkey AS node", "array(concat('id', s_suppkey), concat('alt', s_suppkey), concat('id', s_suppkey)) AS ids", "CASE WHEN s_suppkey % 3 > 0 THEN array(concat('sp', s_suppkey % 4)) END AS species")
    rows = read(spark, sf, "customer").selectExpr("c_custkey AS row", "CASE WHEN c_custkey % 2 = 0 THEN concat('id', c_custkey) ELSE concat('alt', c_custkey) END AS id", "CASE WHEN c_custkey % 5 > 0 THEN concat('sp', c_nationkey % 4) END AS species")
    return r.identifiers(rows, taxa)


TAXA = "SELECT c_custkey AS row, s_suppkey AS node, CASE WHEN s_suppkey % 3 > 0 AND c_custkey % 5 > 0 THEN c_nationkey % 4 = s_suppkey % 4 END AS covered FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey"


def point_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The innermost part of a document that each point is in."""
    parts = read(spark, sf, "orders").selectExpr("o_orderkey AS part", "o_custkey AS doc", "(o_orderkey % 50) * 300 AS start", "(o_orderkey % 50) * 300 + o_orderkey % 7 * 1000 AS stop")
    points = read(spark, sf, "lineitem").selectExpr("l_orderkey * 8 + l_linenumber AS point", "l_partkey AS doc", "l_orderkey % 1500 * 10 AS at").dropDuplicates(["point"])
    points = read(spark, sf, "orders").selectExpr("o_orderkey AS point", "o_custkey AS doc", "o_orderkey * 37 % 20000 AS at")
    return r.containing(points, parts)


POINTS = """
WITH p AS (SELECT o_orderkey AS part, o_custkey AS doc, (o_orderkey % 50) * 300 AS start, (o_orderkey % 50) * 300 + o_orderkey % 7 * 1000 AS stop FROM orders)
SELECT o_orderkey AS point, first(part ORDER BY start DESC, part DESC) AS part FROM orders LEFT JOIN p ON doc = o_custkey AND o_orderkey * 37 % 20000 >= start AND o_orderkey * 37 % 20000 < stop GROUP BY 1
"""


def greedy_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of documents that are kept, from the left, the longest of those that begin together."""
    return r.greedy(read(spark, sf, "orders").selectExpr("o_orderkey AS span", "o_custkey AS doc", "o_orderkey % 400 AS start", "o_orderkey % 400 + o_orderkey % 90 + 1 AS stop"))


GREEDY = """
WITH RECURSIVE s AS (SELECT o_orderkey AS span, o_custkey AS doc, o_orderkey % 400 AS a, o_orderkey % 400 + o_orderkey % 90 + 1 AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 400, -(o_orderkey % 90), o_orderkey) AS k FROM orders),
w AS (SELECT doc, k, CASE WHEN true THEN b END AS e, true AS kept, span FROM s WHERE k = 1 UNION ALL SELECT s.doc, s.k, CASE WHEN s.a >= w.e THEN s.b ELSE w.e END, s.a >= w.e, s.span FROM w JOIN s ON s.doc = w.doc AND s.k = w.k + 1) SELECT doc, span FROM w WHERE kept
"""


def supersession_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Where each chain of supersessions ends."""
    from pyspark.sql import Window

    orders = read(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderstatus")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey"))
    return r.chain_heads(orders.select(F.col("o_orderkey").alias("new"), before.alias("old")).where("old is not null"))


HEADS = "SELECT o_orderkey AS old, head FROM (SELECT o_orderkey, max(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus) AS head FROM orders) WHERE o_orderkey < head"


def desired_state(spark: SparkSession, sf: str) -> DataFrame:
    """K7: actions that turn an actual state into the wanted one."""
    c = read(spark, sf, "customer")
    return r.desired_actions(c.where("c_custkey % 5 > 0").selectExpr("c_name AS name", "c_mktsegment AS value"), c.where("c_custkey % 7 > 0").selectExpr("c_name AS name", "CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE c_mktsegment END AS value"))


ACTIONS = "SELECT c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'create' WHEN c_custkey % 5 = 0 THEN 'delete' ELSE 'update' END AS action, CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS place FROM customer WHERE (c_custkey % 5 > 0) <> (c_custkey % 7 > 0) OR (c_custkey % 5 > 0 AND c_custkey % 7 > 0 AND c_custkey % 3 = 0)"


def overridden_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Records with the filled fields of a manifest in place of what was guessed."""
    c = read(spark, sf, "customer")
    rows = c.selectExpr("c_custkey AS id", "c_name AS title", "cast(NULL AS string) AS year")
    manifest = c.where("c_custkey % 2 = 0").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 4 = 0 THEN 'better' ELSE ' ' END AS title", "CASE WHEN c_custkey % 3 = 0 THEN '2001' END AS year")
    return r.overridden(rows, manifest, "id", ["title", "year"])


OVERRIDDEN = "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'better' ELSE c_name END AS title, CASE WHEN c_custkey % 6 = 0 THEN '2001' END AS year, concat_ws(',', CASE WHEN c_custkey % 4 = 0 THEN 'title' END, CASE WHEN c_custkey % 6 = 0 THEN 'year' END) AS changed FROM customer"


def contract_cells(spark: SparkSession, sf: str) -> DataFrame:
    """V1, V3: cells against a column contract: required, NA, types, vocabularies of each value, unknown columns."""
    rows = read(spark, sf, "part").selectExpr("p_partkey AS row", "CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN 'NA' ELSE p_name END AS name", "CASE WHEN p_size % 4 = 0 THEN 'x1' ELSE cast(p_size AS string) END AS n", "CASE p_size % 3 WHEN 0 THEN 'red|blue' WHEN 1 THEN 'red|odd' ELSE 'NA' END AS colours", "'2024-02-30' AS made", "'?' AS other")
    cells = rows.unpivot("row", ["name", "n", "colours", "made", "other"], "column", "value")
    columns = spark.createDataFrame([("name", True, "string", None, False), ("n", False, "integer", None, False), ("colours", False, "string", "colour", True), ("made", False, "date", None, False)], "column string, required boolean, kind string, vocabulary string, many boolean")
    vocabularies = spark.createDataFrame([("colour", "red"), ("colour", "blue")], "vocabulary string, term string")
    return r.contract(cells, columns, vocabularies)


CELLS = """
SELECT p_partkey AS row, 'name' AS "column", CASE p_size % 6 WHEN 0 THEN 'empty' ELSE 'NA in a required cell' END AS problem FROM part WHERE p_size % 6 < 2 UNION ALL SELECT p_partkey, 'n', 'wrong type' FROM part WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey, 'colours', 'not in vocabulary: odd' FROM part WHERE p_size % 3 = 1
UNION ALL SELECT p_partkey, 'made', 'wrong type' FROM part UNION ALL SELECT p_partkey, 'other', 'unknown column' FROM part
"""


def aligned_cells(spark: SparkSession, sf: str) -> DataFrame:
    """V1, V2: rows whose parallel cells have different numbers of values; an escaped bar is no border."""
    rows = read(spark, sf, "part").selectExpr("p_partkey AS row", "concat('a|b', CASE WHEN p_size % 2 = 0 THEN '|c' ELSE '' END) AS x", "CASE WHEN p_size % 3 = 0 THEN 'a\\\\|b|c' ELSE 'd|e|f' END AS y", "'NA' AS z")
    return r.aligned(rows, [["x", "y"], ["z"]])


ALIGNED = "SELECT p_partkey AS row, 'x+y' AS columns FROM part WHERE (p_size % 2 = 0) = (p_size % 3 = 0)"


def conforming_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records without what their schema does not know, and identifiers without what the source does not hold."""
    rows = read(spark, sf, "part").selectExpr("p_partkey", "map('name', CASE WHEN p_size % 5 > 0 THEN p_name ELSE ' ' END, 'kind', p_type, CASE WHEN p_size % 3 = 0 THEN 'extra' ELSE 'size' END, cast(p_size AS string)) AS m", "array(p_brand, concat('v', p_size), p_name) AS ids", "concat('we used ', upper(p_brand), ' and ', p_name) AS text")
    kept = r.conforming(F.col("m"), ["name", "kind", "size"], {"kind": ["ECONOMY", "PROMO"]})
    grounded = r.source_grounded(F.col("ids"), F.col("text"))
    return rows.select("p_partkey", F.array_join(F.array_sort(F.map_keys(kept["kept"])), ",").alias("kept"), F.array_join(kept["notes"], ",").alias("notes"), F.array_join(grounded["removed"], ",").alias("removed"))


CONFORMING = """
SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN concat_ws(',', CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'kind' END, 'name', CASE WHEN p_size % 3 > 0 THEN 'size' END) END AS kept,
  CASE WHEN p_size % 5 > 0 THEN concat_ws(',', CASE WHEN p_type NOT IN ('ECONOMY', 'PROMO') THEN 'bad value of kind' END, CASE WHEN p_size % 3 = 0 THEN 'unknown field extra' END) END AS notes, CASE WHEN lower('we used ' || p_brand || ' and ' || p_name) LIKE '%v' || p_size || '%' THEN '' ELSE 'v' || p_size END AS removed FROM part
"""


def stale_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files against the hashes that were recorded."""
    c = read(spark, sf, "customer")
    return r.stale(c.where("c_custkey % 4 > 0").selectExpr("c_name AS path", "sha2(c_mktsegment, 256) AS sha"), c.where("c_custkey % 5 > 0").selectExpr("c_name AS path", "sha2(CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END, 256) AS sha"))


STALE = "SELECT c_name AS path, CASE WHEN c_custkey % 5 = 0 THEN 'missing' WHEN c_custkey % 4 = 0 THEN 'unrecorded' WHEN c_custkey % 3 = 0 THEN 'changed' ELSE 'same' END AS state FROM customer WHERE c_custkey % 4 > 0 OR c_custkey % 5 > 0"


def best_copies(spark: SparkSession, sf: str) -> DataFrame:
    """The copy to keep of files with one hash."""
    return r.best_copies(read(spark, sf, "part").selectExpr("md5(p_type) AS sha", "p_size % 4 AS rank", "concat(p_name, '/', p_partkey) AS path"))


COPIES = "SELECT md5(p_type) AS sha, first(p_name || '/' || p_partkey ORDER BY p_size % 4, length(p_name || '/' || p_partkey), p_name || '/' || p_partkey) AS path, count(*) AS copies FROM part GROUP BY 1"


def full_text_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The ten texts that say most of a query, and have all its words."""
    return r.text_rank(read(spark, sf, "part").selectExpr("p_partkey", "concat(p_name, ' ', lower(p_type), 's ', p_name) AS text"), "Red economy", "text", 10).select("p_partkey", "rank")


RANKED = "SELECT p_partkey, round((2 + 1) / (2 * 2 + 1), 6) AS rank FROM part WHERE p_name LIKE 'red %' AND p_type = 'ECONOMY' ORDER BY p_partkey LIMIT 10"


def additive_top(spark: SparkSession, sf: str) -> DataFrame:
    """O3: the twelve rows of the highest additive score, the first among equals."""
    rows = read(spark, sf, "part").selectExpr("p_partkey AS ordinal", "p_size % 5 = 0 AS primary", "array(concat('r', p_size % 3), concat('r', p_size % 7)) AS regions", "p_size % 2 = 0 AS a", "p_size % 3 = 0 AS b", "p_size % 11 = 0 AS c")
    return r.additive_top(rows, ["r1", "r2", "r5"], 12).select("ordinal", "score")


ADDITIVE = """
SELECT p_partkey AS ordinal, (CASE WHEN p_size % 5 = 0 THEN 8 ELSE 0 END + 3 * len(list_intersect(list_distinct(['r' || p_size % 3, 'r' || p_size % 7]), ['r1', 'r2', 'r5'])) + CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 11 = 0 THEN 1 ELSE 0 END)::INTEGER AS score
FROM part ORDER BY score DESC, ordinal LIMIT 12
"""


def unfilled_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Articles with their texts, and rows that the target lacks and that are to be appended."""
    parts = read(spark, sf, "part")
    return r.unfilled(parts.select("p_partkey", "p_name"), read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


UNFILLED = "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)"

QUERIES = {
    "merged_records": (merged_records, MERGED),
    "redirected_graph": (redirected_graph, REDIRECTED),
    "bag_difference": (bag_difference, BAG),
    "entailed_graph": (entailed_graph, ENTAILED),
    "graph_violations": (graph_violations, GRAPH_RULES),
    "nested_entities": (nested_entities, NESTED),
    "observed_checks": (observed_checks, OBSERVED),
    "resource_statuses": (resource_statuses, STATUS),
    "wave_measures": (wave_measures, MEASURES),
    "taxon_lookup": (taxon_lookup, TAXA),
    "point_sections": (point_sections, POINTS),
    "greedy_spans": (greedy_spans, GREEDY),
    "supersession_heads": (supersession_heads, HEADS),
    "desired_state": (desired_state, ACTIONS),
    "overridden_fields": (overridden_fields, OVERRIDDEN),
    "contract_cells": (contract_cells, CELLS),
    "aligned_cells": (aligned_cells, ALIGNED),
    "conforming_records": (conforming_records, CONFORMING),
    "stale_files": (stale_files, STALE),
    "best_copies": (best_copies, COPIES),
    "full_text_rank": (full_text_rank, RANKED),
    "additive_top": (additive_top, ADDITIVE),
    "unfilled_rows": (unfilled_rows, UNFILLED),
}
