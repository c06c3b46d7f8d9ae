"""Queries over the order tables: verdicts, merging, joins, audits, derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators import corrections, entities, verdicts
from brindle.sources.tables import read


def weighted_verdict_score(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on a part, from return flags, weighed by line number with the discount as doubt."""
    lines = read(spark, sf, "lineitem", "l_partkey", "l_returnflag", "l_linenumber", "l_discount", "l_linestatus")
    verdict = F.when(F.col("l_returnflag") == "A", "pass").when(F.col("l_returnflag") == "N", "flag").otherwise("fail")
    rows = lines.select(F.col("l_partkey").alias("item"), verdict.alias("verdict"), F.col("l_linenumber").alias("weight"), F.round(100 - 100 * F.col("l_discount")).cast("long").alias("confidence"), ((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1)).alias("critical"))
    return verdicts.weighted_scores(rows, ["item"], unit=100)


VERDICTS = """
SELECT l_partkey AS item, round(sum(w * c * s) / (200.0::DOUBLE * sum(w)), 4) AS score, count(*) AS reviews, coalesce(bool_or(k AND v = 'fail'), false) AS dropped
FROM (SELECT l_partkey, CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'flag' ELSE 'fail' END AS v, l_linenumber AS w, round(100 - 100 * l_discount)::BIGINT AS c,
             CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END AS s, l_linestatus = 'O' AND l_linenumber = 1 AS k FROM lineitem)
GROUP BY l_partkey
"""


def best_mapping_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """A3, A4: the supplier of each part with the highest price of a line, the first line among equals."""
    lines = read(spark, sf, "lineitem", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    best = entities.best_per_key(lines, ["l_partkey"], F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"))
    names = read(spark, sf, "supplier", "s_suppkey", "s_name")
    return best.join(names, best.l_suppkey == names.s_suppkey, "left").select("l_partkey", "s_name", F.col("l_extendedprice").alias("score"))


BEST = """
SELECT l_partkey, s_name, l_extendedprice AS score
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE k = 1
"""


def canonical_surface(spark: SparkSession, sf: str) -> DataFrame:
    """A2: for every brand the part type that is most common, then longest."""
    return entities.canonical_surface(read(spark, sf, "part", "p_brand", "p_type"), ["p_brand"], "p_type")


CANONICAL = """
SELECT p_brand, p_type, uses FROM (SELECT p_brand, p_type, count(*) AS uses, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, length(p_type) DESC, p_type) AS k FROM part GROUP BY 1, 2) WHERE k = 1
"""


def conflicting_ids(spark: SparkSession, sf: str) -> DataFrame:
    """A5: parts with lines of more than one supplier, by pairs first."""
    pairs = read(spark, sf, "lineitem", "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("suppliers"), F.sum("n").alias("lines")).where("suppliers > 1")


CONFLICTS = "SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers, count(*) AS lines FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1"


def consensus_direction(spark: SparkSession, sf: str) -> DataFrame:
    """Direction of a part's findings over orders as papers, with agreement and verdict."""
    lines = read(spark, sf, "lineitem", "l_partkey", "l_orderkey", "l_returnflag", "l_discount")
    direction = F.when(F.col("l_returnflag") == "R", "negative").when(F.col("l_discount") >= 0.05, "positive").otherwise("null")
    return verdicts.consensus(lines.select(F.col("l_partkey").alias("construct"), F.col("l_orderkey").alias("paper"), direction.alias("direction")))


CONSENSUS = """
WITH c AS (SELECT DISTINCT l_partkey AS construct, l_orderkey AS paper, CASE WHEN l_returnflag = 'R' THEN 'negative' WHEN l_discount >= 0.05 THEN 'positive' ELSE 'null' END AS direction FROM lineitem),
a AS (SELECT construct, count(DISTINCT paper) AS papers, count(*) FILTER (direction = 'positive') AS positive, count(*) FILTER (direction = 'negative') AS negative, count(*) FILTER (direction = 'null') AS neutral, count(*) AS claims FROM c GROUP BY 1)
SELECT construct, papers, positive, negative, neutral, round(greatest(positive, negative, neutral) / claims, 3) AS agreement,
       CASE WHEN papers < 2 THEN 'insufficient_papers' WHEN positive > 0 AND negative > 0 THEN 'divergent' WHEN greatest(positive, negative, neutral) / claims >= 0.7 THEN 'consensus' ELSE 'mixed' END AS verdict
FROM a
"""


def role_exclusivity(spark: SparkSession, sf: str) -> DataFrame:
    """The roles, order priorities, of a customer over years as papers: dominant share and exclusivity."""
    orders = read(spark, sf, "orders", "o_custkey", "o_orderdate", "o_orderpriority")
    return verdicts.role_exclusivity(orders.select(F.col("o_custkey").alias("variable"), F.year("o_orderdate").alias("paper"), F.col("o_orderpriority").alias("role")))


ROLES = """
WITH p AS (SELECT DISTINCT o_custkey AS variable, year(o_orderdate) AS paper, o_orderpriority AS role FROM orders),
s AS (SELECT variable, paper, count(*) AS roles FROM p GROUP BY 1, 2),
c AS (SELECT variable, role, count(*) AS n, count(*) FILTER (roles = 1) AS alone FROM p JOIN s USING (variable, paper) GROUP BY 1, 2),
t AS (SELECT variable, count(*) AS papers FROM s GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, role) AS k FROM c)
SELECT variable, role AS dominant_role, papers, round(n / papers, 3) AS dominant_share, round(alone / papers, 3) AS exclusivity,
       CASE WHEN papers < 2 THEN 'insufficient' WHEN alone = papers THEN 'consistent' WHEN n / papers >= 0.7 THEN 'contested' ELSE 'mixed' END AS verdict
FROM r JOIN t USING (variable) WHERE k = 1
"""


def role_matrix_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Order states of each priority as a matrix of counts."""
    orders = read(spark, sf, "orders", "o_orderpriority", "o_orderstatus")
    return orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


MATRIX = "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1"


def prior_wave_control(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of years before a customer's last year are its controls."""
    orders = read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("wave"))
    last = orders.groupBy("o_custkey").agg(F.max("wave").alias("last"))
    role = F.when(F.col("wave") < F.col("last"), "control").otherwise("outcome")
    return orders.join(last, "o_custkey").groupBy("o_custkey", role.alias("role")).agg(F.count(F.lit(1)).alias("orders"), F.max("wave").alias("wave"))


PRIOR = """
WITH o AS (SELECT o_custkey, year(o_orderdate)::INTEGER AS wave FROM orders), l AS (SELECT *, max(wave) OVER (PARTITION BY o_custkey) AS last FROM o)
SELECT o_custkey, CASE WHEN wave < last THEN 'control' ELSE 'outcome' END AS role, count(*) AS orders, max(wave) AS wave FROM l GROUP BY 1, 2
"""


def strength_rating(spark: SparkSession, sf: str) -> DataFrame:
    """Strength of a customer's evidence from its balance band, its years, and what is missing."""
    orders = read(spark, sf, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    seen = orders.groupBy("o_custkey").agg(F.count_distinct(F.year("o_orderdate")).alias("waves"), F.max("o_totalprice").alias("effect"))
    customers = read(spark, sf, "customer", "c_custkey", "c_acctbal", "c_mktsegment")
    joined = customers.join(seen, F.col("c_custkey") == F.col("o_custkey"), "left")
    n = F.when(F.col("c_acctbal") >= 5000, 3).when(F.col("c_acctbal") >= 1000, 2).otherwise(1)
    points = n + F.when(F.col("waves") > 1, 1).otherwise(0) - F.when(F.col("effect").isNull(), 1).otherwise(0) - F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0)
    return joined.select("c_custkey", points.alias("points"), F.when(points >= 4, "strong").when(points == 3, "moderate").otherwise("weak").alias("strength"))


STRENGTH = """
WITH s AS (SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS waves, max(o_totalprice) AS effect FROM orders GROUP BY 1),
p AS (SELECT c_custkey, (CASE WHEN c_acctbal >= 5000 THEN 3 WHEN c_acctbal >= 1000 THEN 2 ELSE 1 END + CASE WHEN waves > 1 THEN 1 ELSE 0 END - CASE WHEN effect IS NULL THEN 1 ELSE 0 END - CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END)::INTEGER AS points
      FROM customer LEFT JOIN s ON c_custkey = o_custkey)
SELECT c_custkey, points, CASE WHEN points >= 4 THEN 'strong' WHEN points = 3 THEN 'moderate' ELSE 'weak' END AS strength FROM p
"""


def merge_duplicates_best_status(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders of one year are one record: the best status wins, then the smallest key."""
    orders = read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus").withColumn("wave", F.year("o_orderdate"))
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    merged = orders.groupBy("o_custkey", "wave").agg(F.min(F.struct(rank.alias("r"), "o_orderkey", "o_orderstatus")).alias("best"), F.count(F.lit(1)).alias("merged"))
    return merged.select("o_custkey", "wave", F.col("best.o_orderkey").alias("o_orderkey"), F.col("best.o_orderstatus").alias("status"), "merged")


MERGED = """
SELECT o_custkey, wave, o_orderkey, o_orderstatus AS status, merged
FROM (SELECT o_custkey, year(o_orderdate)::INTEGER AS wave, o_orderkey, o_orderstatus, count(*) OVER w AS merged, row_number() OVER (w ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderkey) AS k
      FROM orders WINDOW w AS (PARTITION BY o_custkey, year(o_orderdate))) WHERE k = 1
"""


def coverage_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each brand's parts that any line refers to."""
    parts = read(spark, sf, "part", "p_partkey", "p_brand")
    used = read(spark, sf, "lineitem", F.col("l_partkey").alias("p_partkey")).distinct().withColumn("used", F.lit(1))
    counted = parts.join(used, "p_partkey", "left").groupBy("p_brand").agg(F.count(F.lit(1)).alias("declared"), F.count("used").alias("referenced"))
    return counted.withColumn("coverage", F.round(F.col("referenced") / F.col("declared"), 4))


COVERAGE = """
SELECT p_brand, count(*) AS declared, count(u.l_partkey) AS referenced, round(count(u.l_partkey) / count(*), 4) AS coverage
FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem) u ON l_partkey = p_partkey GROUP BY 1
"""


def derivation_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Named numbers derived from the tables, one row each."""
    orders, lines = read(spark, sf, "orders", "o_orderstatus", "o_totalprice", "o_custkey"), read(spark, sf, "lineitem", "l_quantity")
    a = orders.agg(F.count(F.lit(1)).cast("double").alias("orders"), F.count_distinct("o_custkey").cast("double").alias("customers"), F.round(F.median("o_totalprice"), 4).alias("median_price"), F.max("o_totalprice").alias("max_price"), F.sum(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("finished"))
    b = lines.agg(F.round(F.avg("l_quantity"), 4).alias("mean_quantity"), F.min("l_quantity").alias("min_quantity"))
    # Two frames of one row each.
    both = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").withColumn("finished_percent", F.round(100 * F.try_divide("finished", "orders"), 4)).drop("k")
    return both.unpivot([], both.columns, "name", "value")


DERIVED = """
WITH o AS (SELECT count(*)::DOUBLE AS orders, count(DISTINCT o_custkey)::DOUBLE AS customers, round(median(o_totalprice), 4) AS median_price, max(o_totalprice) AS max_price, sum(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS finished FROM orders),
l AS (SELECT round(avg(l_quantity), 4) AS mean_quantity, min(l_quantity) AS min_quantity FROM lineitem)
SELECT 'orders' AS name, orders AS value FROM o UNION ALL SELECT 'customers', customers FROM o UNION ALL SELECT 'median_price', median_price FROM o UNION ALL SELECT 'max_price', max_price FROM o UNION ALL SELECT 'finished', finished FROM o
UNION ALL SELECT 'mean_quantity', mean_quantity FROM l UNION ALL SELECT 'min_quantity', min_quantity FROM l UNION ALL SELECT 'finished_percent', round(100 * finished / orders, 4) FROM o
"""


def flow_identities(spark: SparkSession, sf: str) -> DataFrame:
    """The funnel of order states by year, and whether its parts add up."""
    orders = read(spark, sf, "orders", "o_orderdate", "o_orderstatus")
    count = lambda s: F.count_if(F.col("o_orderstatus") == s)
    flow = orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("identified"), count("F").alias("included"), count("O").alias("pending"), count("P").alias("partial"))
    return flow.withColumn("adds_up", F.col("identified") == F.col("included") + F.col("pending") + F.col("partial"))


FLOW = """
SELECT year, identified, included, pending, partial, identified = included + pending + partial AS adds_up
FROM (SELECT year(o_orderdate)::INTEGER AS year, count(*) AS identified, count(*) FILTER (o_orderstatus = 'F') AS included, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS partial FROM orders GROUP BY 1)
"""


def year_histogram_gap_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Orders above a price by month, months without any included."""
    orders = read(spark, sf, "orders", "o_orderdate", "o_totalprice").where("o_totalprice > 300000")
    months = orders.select((F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    span = months.agg(F.min("m").alias("a"), F.max("m").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("m"))
    filled = span.join(months, "m", "left")
    return filled.select(F.floor(F.col("m") / 12).cast("int").alias("year"), (F.col("m") % 12 + 1).alias("month"), F.coalesce("n", F.lit(0)).alias("orders"))


HISTOGRAM = """
WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1),
s AS (SELECT unnest(range((SELECT min(m) FROM m), (SELECT max(m) FROM m) + 1)) AS m)
SELECT (m // 12)::INTEGER AS year, (m % 12 + 1)::INTEGER AS month, coalesce(n, 0) AS orders FROM s LEFT JOIN m USING (m)
"""


def review_sheet_join(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their order and supplier, for returned goods of finished orders."""
    lines = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_extendedprice").where("l_returnflag = 'R'")
    orders = read(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_custkey").where("o_orderstatus = 'F'")
    suppliers = read(spark, sf, "supplier", "s_suppkey", "s_name")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(suppliers, lines.l_suppkey == suppliers.s_suppkey, "left")
    return joined.select("l_orderkey", "l_linenumber", "o_custkey", F.coalesce("s_name", F.lit("NA")).alias("supplier"), "l_extendedprice")


SHEET = """
SELECT l_orderkey, l_linenumber, o_custkey, coalesce(s_name, 'NA') AS supplier, l_extendedprice
FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' AND o_orderstatus = 'F'
"""


def current_not_superseded(spark: SparkSession, sf: str) -> DataFrame:
    """Of a customer's orders of one priority each supersedes the one before; those that none supersedes."""
    orders = read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    chained = orders.withColumn("supersedes", before)
    gone = chained.where("supersedes is not null").select(F.col("supersedes").alias("o_orderkey"))
    return chained.join(gone, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey", "supersedes")


CURRENT = """
WITH c AS (SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS supersedes FROM orders)
SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.supersedes = a.o_orderkey)
"""


def referential_violations_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of parts or of suppliers that don't exist, and orders without a line, as violations."""
    lines = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    row = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), key.alias("key")).groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n"))
    parts = row(lines.join(read(spark, sf, "part", F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti"), "unknown_part", F.col("l_partkey"))
    suppliers = row(lines.join(read(spark, sf, "supplier", F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_anti"), "unknown_supplier", F.col("l_suppkey"))
    empty = row(read(spark, sf, "orders", F.col("o_orderkey").alias("l_orderkey")).join(lines, "l_orderkey", "left_anti"), "order_without_lines", F.col("l_orderkey"))
    return parts.unionByName(suppliers).unionByName(empty)


VIOLATIONS_WHOLE = """
SELECT 'unknown_part' AS rule, l_partkey AS key, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey) GROUP BY 2
UNION ALL SELECT 'unknown_supplier', l_suppkey, count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey) GROUP BY 2
UNION ALL SELECT 'order_without_lines', o_orderkey, count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 2
"""


def cascade_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Customers matched to suppliers by number and nation, else number, else the nation's first; best tier wins."""
    customers, suppliers = read(spark, sf, "customer", "c_custkey", "c_nationkey"), read(spark, sf, "supplier", "s_suppkey", "s_nationkey")
    same = (F.col("c_custkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))
    first = suppliers.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("s_suppkey"))
    tiers = [customers.join(suppliers, same).select("c_custkey", "s_suppkey", F.lit(0).alias("tier")), customers.join(suppliers, F.col("c_custkey") == F.col("s_suppkey")).select("c_custkey", "s_suppkey", F.lit(1).alias("tier")), customers.join(first, "c_nationkey").select("c_custkey", "s_suppkey", F.lit(2).alias("tier"))]
    return entities.best_per_key(tiers[0].unionByName(tiers[1]).unionByName(tiers[2]), ["c_custkey"], F.asc("tier"), F.asc("s_suppkey"))


CASCADE = """
WITH t AS (SELECT c_custkey, s_suppkey, 0 AS tier FROM customer JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey
UNION ALL SELECT c_custkey, s_suppkey, 1 FROM customer JOIN supplier ON c_custkey = s_suppkey
UNION ALL SELECT c_custkey, min(s_suppkey), 2 FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1)
SELECT c_custkey, s_suppkey, tier FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY tier, s_suppkey) AS k FROM t) WHERE k = 1
"""


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """customers' spending before and since 1995: added, removed, changed by a hundredth or more, same."""
    orders = read(spark, sf, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    side = lambda cond, name: orders.where(cond).groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias(name))
    both = side("o_orderdate < timestamp_ntz'1995-01-01'", "old").join(side("o_orderdate >= timestamp_ntz'1995-01-01'", "new"), "o_custkey", "full")
    apart = F.abs(F.col("new") - F.col("old")) / F.greatest(F.abs("old"), F.abs("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(apart < 0.01, "same").otherwise("changed")
    return both.select("o_custkey", "old", "new", change.alias("change"))


DIFF = """
WITH a AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS old FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1), b AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS new FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1)
SELECT o_custkey, old, new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN abs(new - old) / greatest(abs(old), abs(new)) < 0.01 THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (o_custkey)
"""


def cooccurrence_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of brands in one order, by number of orders; a part's brand stands once in an order."""
    lines = read(spark, sf, "lineitem", "l_orderkey", "l_partkey").join(read(spark, sf, "part", F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    once = lines.select("l_orderkey", "p_brand").distinct()
    pairs = once.join(once.withColumnRenamed("p_brand", "other"), "l_orderkey").where("p_brand < other")
    return pairs.groupBy("p_brand", "other").agg(F.count(F.lit(1)).alias("orders"))


PAIRS = """
WITH o AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT a.p_brand, b.p_brand AS other, count(*) AS orders FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY 1, 2
"""


def free_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """What of a part's size its lines leave free, by brand, nothing below zero."""
    used = read(spark, sf, "lineitem", "l_partkey", "l_quantity").groupBy("l_partkey").agg(F.avg("l_quantity").alias("used"))
    parts = read(spark, sf, "part", "p_partkey", "p_brand", "p_size")
    free = F.greatest(F.lit(0.0), F.col("p_size") - F.coalesce("used", F.lit(0.0)))
    return parts.join(used, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("p_brand").agg(F.sum(F.col("p_size").cast("long")).alias("configured"), F.round(F.sum(free), 2).alias("free"))


FREE = """
SELECT p_brand, sum(p_size)::BIGINT AS configured, round(sum(greatest(0.0, p_size - coalesce(used, 0.0))), 2) AS free
FROM part LEFT JOIN (SELECT l_partkey, avg(l_quantity) AS used FROM lineitem GROUP BY 1) ON p_partkey = l_partkey GROUP BY 1
"""


def jaccard_sets_whole(spark: SparkSession, sf: str) -> DataFrame:
    """how alike order priorities are in the part types that their orders hold, orders of every status."""
    lines = read(spark, sf, "lineitem", "l_orderkey", "l_partkey").join(read(spark, sf, "part", F.col("p_partkey").alias("l_partkey"), "p_type", "p_size"), "l_partkey")
    held = lines.join(read(spark, sf, "orders", F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    once = held.select("o_orderpriority", F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("e")).distinct()
    sizes = once.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    shared = once.join(once.withColumnRenamed("o_orderpriority", "other"), "e").where("o_orderpriority < other").groupBy("o_orderpriority", "other").agg(F.count(F.lit(1)).alias("shared"))
    joined = shared.join(sizes, "o_orderpriority").join(sizes.select(F.col("o_orderpriority").alias("other"), F.col("n").alias("m")), "other")
    return joined.select("o_orderpriority", "other", "shared", F.round(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")), 4).alias("jaccard"))


JACCARD_WHOLE = """
WITH o AS (SELECT DISTINCT o_orderpriority, p_type || '/' || p_size AS e FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
c AS (SELECT o_orderpriority, count(*) AS n FROM o GROUP BY 1),
s AS (SELECT a.o_orderpriority, b.o_orderpriority AS other, count(*) AS shared FROM o a JOIN o b ON a.e = b.e AND a.o_orderpriority < b.o_orderpriority GROUP BY 1, 2)
SELECT s.o_orderpriority, other, shared, round(shared / (c.n + d.n - shared), 4) AS jaccard FROM s JOIN c ON c.o_orderpriority = s.o_orderpriority JOIN c d ON d.o_orderpriority = s.other
"""


def contract_validation(spark: SparkSession, sf: str) -> DataFrame:
    """V1: customers' cells against a contract: required, type, range and vocabulary; violations by column and rule."""
    cells = read(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_mktsegment").unpivot("c_custkey", ["c_name", "c_acctbal", "c_mktsegment"], "column", "value")
    rule = F.when(F.col("value").isNull() | (F.col("value") == ""), "required").when((F.col("column") == "c_acctbal") & (F.try_to_number("value", F.lit("S999999999D99")).isNull()) & F.col("value").cast("double").isNull(), "type")
    rule = rule.when((F.col("column") == "c_acctbal") & (F.col("value").cast("double") < 0), "range").when((F.col("column") == "c_mktsegment") & ~F.col("value").isin("AUTOMOBILE", "MACHINERY", "FURNITURE"), "vocabulary")
    return cells.withColumn("rule", rule).where("rule is not null").groupBy("column", "rule").agg(F.count(F.lit(1)).alias("violations"), F.min("c_custkey").alias("first_row"))


CONTRACT = """
SELECT 'c_acctbal' AS "column", 'range' AS rule, count(*) AS violations, min(c_custkey) AS first_row FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0
UNION ALL SELECT 'c_mktsegment', 'vocabulary', count(*), min(c_custkey) FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'MACHINERY', 'FURNITURE') HAVING count(*) > 0
UNION ALL SELECT 'c_name', 'required', count(*), min(c_custkey) FROM customer WHERE c_name IS NULL OR c_name = '' HAVING count(*) > 0
"""


def oplog_fold(spark: SparkSession, sf: str) -> DataFrame:
    """K1: lines as operations on a part in order of shipping; the last of each kind decides, a drop only if nothing restores."""
    lines = read(spark, sf, "lineitem", "l_partkey", "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    op = F.when(F.col("l_returnflag") == "R", "drop").when(F.col("l_returnflag") == "A", "restore").otherwise("set")
    return verdicts.oplog(lines.select(F.col("l_partkey").alias("id"), op.alias("op"), F.col("l_quantity").alias("value"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at")))


OPLOG = """
WITH o AS (SELECT l_partkey AS id, CASE l_returnflag WHEN 'R' THEN 'drop' WHEN 'A' THEN 'restore' ELSE 'set' END AS op, l_quantity AS value, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem)
SELECT id, count(*) AS ops, arg_max(value, k) FILTER (op = 'set') AS value, coalesce(max(k) FILTER (op = 'drop') > coalesce(max(k) FILTER (op = 'restore'), 0), false) AS dropped FROM o GROUP BY id
"""


def _renamings(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of four: the first is renamed to the second, that to the third, that to the fourth; some first ones have two names."""
    own = read(spark, sf, "customer", F.col("c_custkey").alias("old"))
    return own.where("old % 4 < 3").withColumn("new", F.col("old") + 1).unionByName(own.where("old % 40 = 0").withColumn("new", F.col("old") + 2))


def rekeyed_everywhere(spark: SparkSession, sf: str) -> DataFrame:
    """K3: every foreign key of customers after chains of renamings, and the keys that could not be renamed."""
    tables = {"customer": (read(spark, sf, "customer", F.col("c_custkey").alias("id"), F.col("c_custkey").alias("key")), ["key"]), "orders": (read(spark, sf, "orders", F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key")), ["key"])}
    done, problems = corrections.rekeyed(tables, _renamings(spark, sf))
    rows = problems.select(F.col("problem").alias("place"), F.col("key").alias("id"), "key")
    for name, rekeyed in done.items():
        rows = rows.unionByName(rekeyed.select(F.lit(name).alias("place"), "id", "key"))
    return rows


REKEYED = """
WITH ends AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 3 OR c_custkey % 40 = 0 THEN c_custkey ELSE least(c_custkey - c_custkey % 4 + 3, (SELECT max(c_custkey) + 1 FROM customer)) END AS e FROM customer)
SELECT 'clash' AS place, c_custkey AS id, c_custkey AS key FROM customer WHERE c_custkey % 40 = 0
UNION ALL SELECT 'customer', k, e FROM ends UNION ALL SELECT 'orders', o_orderkey, coalesce(e, o_custkey) FROM orders LEFT JOIN ends ON k = o_custkey
"""


def segment_nations(spark: SparkSession, sf: str) -> DataFrame:
    """U4: by market segment, the nations of customers in debt and of others: shared, and those of either side only."""
    rows = read(spark, sf, "customer", "c_mktsegment", "c_nationkey", "c_acctbal")
    found = corrections.set_algebra(rows.where("c_acctbal < 0"), rows.where("c_acctbal >= 0"), "c_mktsegment", "c_nationkey")
    return found.select("c_mktsegment", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("shared", "only_left", "only_right")])


SEGMENTS = """
WITH s AS (SELECT c_mktsegment, coalesce(list(DISTINCT c_nationkey) FILTER (c_acctbal < 0), []) AS l, coalesce(list(DISTINCT c_nationkey) FILTER (c_acctbal >= 0), []) AS r FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1)
SELECT c_mktsegment, array_to_string(list_sort(list_intersect(l, r)), ',') AS shared, array_to_string(list_sort(list_filter(l, lambda x: NOT list_contains(r, x))), ',') AS only_left, array_to_string(list_sort(list_filter(r, lambda x: NOT list_contains(l, x))), ',') AS only_right FROM s
"""

QUERIES = {
    "rekeyed_everywhere": (rekeyed_everywhere, REKEYED),
    "segment_nations": (segment_nations, SEGMENTS),
    "weighted_verdict_score": (weighted_verdict_score, VERDICTS),
    "best_mapping_per_key": (best_mapping_per_key, BEST),
    "canonical_surface": (canonical_surface, CANONICAL),
    "conflicting_ids": (conflicting_ids, CONFLICTS),
    "consensus_direction": (consensus_direction, CONSENSUS),
    "role_exclusivity": (role_exclusivity, ROLES),
    "role_matrix_pivot": (role_matrix_pivot, MATRIX),
    "prior_wave_control": (prior_wave_control, PRIOR),
    "strength_rating": (strength_rating, STRENGTH),
    "merge_duplicates_best_status": (merge_duplicates_best_status, MERGED),
    "coverage_audit": (coverage_audit, COVERAGE),
    "derivation_catalog": (derivation_catalog, DERIVED),
    "flow_identities": (flow_identities, FLOW),
    "year_histogram_gap_filled": (year_histogram_gap_filled, HISTOGRAM),
    "review_sheet_join": (review_sheet_join, SHEET),
    "current_not_superseded": (current_not_superseded, CURRENT),
    "referential_violations_whole": (referential_violations_whole, VIOLATIONS_WHOLE),
    "cascade_identity": (cascade_identity, CASCADE),
    "snapshot_diff": (snapshot_diff, DIFF),
    "cooccurrence_pairs": (cooccurrence_pairs, PAIRS),
    "free_capacity": (free_capacity, FREE),
    "jaccard_sets_whole": (jaccard_sets_whole, JACCARD_WHOLE),
    "contract_validation": (contract_validation, CONTRACT),
    "oplog_fold": (oplog_fold, OPLOG),
}
