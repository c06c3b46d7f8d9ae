"""Triple-graph queries over the order tables as triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import graph as g
from brindle.sources.tables import read


def _places(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")
    inside = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return g.triples(g.triple(inside, F.col("n_name"), "subClassOf", F.col("r_name")), g.triple(region, F.col("r_name"), "subClassOf", F.lit("WORLD")))


def triple_shared_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of nations by the parts that suppliers of both ship, most first; patterns (s supplies part), (s in nation)."""
    # One table a predicate, with typed ends; only the pairs that are asked about are made distinct.
    supplies = read(spark, sf, "lineitem", F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("part"))
    inside = read(spark, sf, "supplier", F.col("s_suppkey").alias("s"), F.col("s_nationkey").cast("string").alias("nation"))
    held = supplies.join(inside, "s").select("part", "nation").distinct()
    pairs = held.join(held.withColumnRenamed("nation", "other"), "part").where("nation < other")
    return pairs.groupBy("nation", "other").agg(F.count(F.lit(1)).alias("parts"))


SHARED = """
WITH h AS (SELECT DISTINCT l_partkey AS part, s_nationkey::VARCHAR AS nation FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT a.nation, b.nation AS other, count(*) AS parts FROM h a JOIN h b ON a.part = b.part AND a.nation < b.nation GROUP BY 1, 2
"""


def triple_optional_union_minus(spark: SparkSession, sf: str) -> DataFrame:
    """Customers or suppliers in a nation, with a rich mark if there is one, without those of nations in EUROPE."""
    customers, suppliers, nation, region = read(spark, sf, "customer"), read(spark, sf, "supplier"), read(spark, sf, "nation"), read(spark, sf, "region")
    inside = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    graph = g.triples(
        g.triple(customers, F.col("c_name"), "buyerIn", F.col("c_nationkey")), g.triple(suppliers, F.col("s_name"), "sellerIn", F.col("s_nationkey")),
        g.triple(customers.where("c_acctbal > 5000"), F.col("c_name"), "mark", F.lit("rich")), g.triple(suppliers.where("s_acctbal > 5000"), F.col("s_name"), "mark", F.lit("rich")), g.triple(inside, F.col("n_nationkey"), "partOf", F.col("r_name")),
    )
    union = g.pattern(graph, "buyerIn", "who", "nation").withColumn("tag", F.lit("buyer")).unionByName(g.pattern(graph, "sellerIn", "who", "nation").withColumn("tag", F.lit("seller")))
    optional = union.join(g.pattern(graph, "mark", "who", "mark"), "who", "left")
    europe = g.pattern(graph, "partOf", "nation", "region").where("region = 'EUROPE'").select("nation")
    return optional.join(europe, "nation", "left_anti").select("who", "tag", "nation", F.coalesce("mark", F.lit("-")).alias("mark"))


OPTIONAL = """
WITH u AS (SELECT c_name AS who, c_nationkey AS k, 'buyer' AS tag, c_acctbal AS b FROM customer UNION ALL SELECT s_name, s_nationkey, 'seller', s_acctbal FROM supplier)
SELECT who, tag, k::VARCHAR AS nation, CASE WHEN b > 5000 THEN 'rich' ELSE '-' END AS mark FROM u
WHERE k NOT IN (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE')
"""


def subclass_closure(spark: SparkSession, sf: str) -> DataFrame:
    """All classes above each place, by any number of steps."""
    return g.closure(g.pattern(_places(spark, sf), "subClassOf", "s", "o"))


CLOSURE = """
WITH RECURSIVE e AS (SELECT n_name AS s, r_name AS o FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT r_name, 'WORLD' FROM region),
c AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON e.s = c.o) SELECT s, o FROM c
"""

def connected_components_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and parts joined by any line, by component; recursive SQL is too slow for it, a test has brute force."""
    lines = read(spark, sf, "lineitem", "l_suppkey", "l_partkey")
    return g.components(lines.select((-F.col("l_suppkey")).alias("s"), F.col("l_partkey").alias("o")))


def saturated_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in nations in regions, with all that a transitive relation, a chain, a subproperty, a domain and equal nodes entail."""
    customers = read(spark, sf, "customer", "c_custkey", "c_nationkey")
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    nations = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    twins = customers.where("c_custkey % 100 = 1").select(name.alias("s"), F.lit("sameAs").alias("p"), F.concat(F.lit("c"), (F.col("c_custkey") - 1).cast("string")).alias("o"))
    schema = spark.createDataFrame([("within", "type", "TransitiveProperty"), ("livesIn", "propertyChainAxiom", "livesIn within"), ("livesIn", "subPropertyOf", "knownIn"), ("livesIn", "domain", "Person"), ("Person", "subClassOf", "Agent")], "s string, p string, o string")
    nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    parts = [
        schema, twins, g.triple(customers, name, "livesIn", nation),
        g.triple(nations, F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), "within", F.col("r_name")),
        g.triple(nations.select("r_name").distinct(), F.col("r_name"), "within", F.lit("WORLD")),
    ]
    return g.saturated(g.triples(*parts))


SATURATED = """
WITH names AS (SELECT c_custkey, c_nationkey, 'c' || c_custkey AS own, CASE WHEN c_custkey % 100 = 1 THEN 'c' || (c_custkey - 1) WHEN c_custkey % 100 = 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer) THEN 'c' || (c_custkey + 1) END AS twin FROM customer),
named AS (SELECT *, least(own, coalesce(twin, own)) AS node FROM names),
places AS (SELECT 'n' || n_nationkey AS s, r_name AS o FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT r_name, 'WORLD' FROM nation JOIN region ON r_regionkey = n_regionkey),
within AS (SELECT s, o FROM places UNION SELECT a.s, b.o FROM places a JOIN places b ON b.s = a.o),
lives AS (SELECT DISTINCT node AS s, 'n' || c_nationkey AS o FROM named), everywhere AS (SELECT s, o FROM lives UNION SELECT l.s, w.o FROM lives l JOIN within w ON w.s = l.o)
SELECT s, 'within' AS p, o FROM within UNION ALL SELECT s, 'livesIn', o FROM everywhere UNION ALL SELECT s, 'knownIn', o FROM everywhere
UNION ALL SELECT DISTINCT s, 'type', c FROM lives, (SELECT unnest(['Person', 'Agent']) AS c) UNION ALL SELECT own, 'sameAs', node FROM named WHERE own <> node UNION ALL SELECT 'c' || (c_custkey - 1), 'sameAs', node FROM named WHERE c_custkey % 100 = 1 AND node <> 'c' || (c_custkey - 1) AND c_custkey - 1 NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT * FROM (VALUES ('within', 'type', 'TransitiveProperty'), ('livesIn', 'propertyChainAxiom', 'livesIn within'), ('livesIn', 'subPropertyOf', 'knownIn'), ('livesIn', 'domain', 'Person'), ('Person', 'subClassOf', 'Agent'))
"""

QUERIES = {
    "connected_components_whole": (connected_components_whole, None),
    "triple_shared_entities": (triple_shared_entities, SHARED),
    "triple_optional_union_minus": (triple_optional_union_minus, OPTIONAL),
    "subclass_closure": (subclass_closure, CLOSURE),
    "saturated_graph": (saturated_graph, SATURATED),
}
