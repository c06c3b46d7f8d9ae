"""Terms and wordings against a lexicon and a dictionary that are made from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import context, lexicon
from brindle.sources.shared import dealt
from brindle.sources.tables import read


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").selectExpr("CASE p_size % 5 WHEN 0 THEN concat('RedRing', p_partkey) WHEN 1 THEN concat('blue  Rings', CASE WHEN p_size % 2 = 0 THEN '' ELSE ' plates' END) WHEN 2 THEN concat('Term-', p_partkey, ' bodies') WHEN 3 THEN 'abc' ELSE concat('β cells ', p_partkey % 40) END AS term", "CASE WHEN p_size % 3 = 0 THEN 'Cell' WHEN p_size % 3 = 1 THEN 'Gene' END AS label")


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.lexicon(read(spark, sf, "part").selectExpr(
        "concat('s', p_partkey % 3) AS source", "concat('http://x/', CASE p_partkey % 2 WHEN 0 THEN 'CL_' ELSE 'GO_' END, p_partkey % 60) AS iri", "CASE p_partkey % 2 WHEN 0 THEN 'CL' ELSE 'GO' END AS prefix", "CASE p_size % 4 WHEN 0 THEN 'label' WHEN 1 THEN 'exact_synonym' WHEN 2 THEN 'related_synonym' ELSE 'odd' END AS match_type",
        "CASE p_partkey % 5 WHEN 0 THEN concat('red ring', p_partkey) WHEN 1 THEN 'Blue ring' WHEN 2 THEN concat('term ', p_partkey, ' body') WHEN 3 THEN 'ABC' ELSE concat('Beta Cell ', p_partkey % 40) END AS value", "concat('L', p_partkey % 60) AS label",
    ))


_LEX = """t AS (SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN 'RedRing' || p_partkey WHEN 1 THEN 'blue  Rings' || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' plates' END WHEN 2 THEN 'Term-' || p_partkey || ' bodies' WHEN 3 THEN 'abc' ELSE 'β cells ' || p_partkey % 40 END AS term, CASE WHEN p_size % 3 = 0 THEN 'Cell' WHEN p_size % 3 = 1 THEN 'Gene' END AS label,
  CASE p_size % 5 WHEN 0 THEN ['redring' || p_partkey, 'red ring' || p_partkey] WHEN 1 THEN ['blue rings' || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' plates' END] WHEN 2 THEN ['term ' || p_partkey || ' bodies'] WHEN 3 THEN ['abc'] ELSE ['beta cells ' || p_partkey % 40] END AS written,
  CASE p_size % 5 WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN ['blue ring'] ELSE ['blue rings plate'] END WHEN 2 THEN ['term ' || p_partkey || ' body', 'term ' || p_partkey || ' bodie'] ELSE [] END AS singles FROM part),
v AS (SELECT term, label, unnest(written) AS key, 0 AS variant_rank FROM t UNION SELECT term, label, unnest(singles), 1 FROM t),
e AS (SELECT DISTINCT 's' || p_partkey % 3 AS source, p_partkey % 3 AS priority, 'http://x/' || CASE p_partkey % 2 WHEN 0 THEN 'CL_' ELSE 'GO_' END || p_partkey % 60 AS iri, CASE p_partkey % 2 WHEN 0 THEN 'CL' ELSE 'GO' END AS prefix, (['label', 'exact_synonym', 'related_synonym', 'odd'])[p_size % 4 + 1] AS match_type, ([0, 1, 5, -1])[p_size % 4 + 1] AS match_rank,
  CASE p_partkey % 5 WHEN 0 THEN 'red ring' || p_partkey WHEN 1 THEN 'blue ring' WHEN 2 THEN 'term ' || p_partkey || ' body' WHEN 3 THEN 'abc' ELSE 'beta cell ' || p_partkey % 40 END AS key, 'L' || p_partkey % 60 AS concept_label FROM part),
c AS (SELECT term, label, iri, concept_label, source, match_type, match_rank, priority, CASE WHEN label = 'Cell' THEN CASE prefix WHEN 'CL' THEN 0 ELSE 1 END ELSE 0 END AS route_rank, variant_rank FROM v JOIN e USING (key) WHERE match_rank >= 0 AND (label IS NOT DISTINCT FROM 'Cell' OR length(regexp_replace(term, '[^A-Za-z0-9]', '', 'g')) > 3)),
f AS (SELECT * FROM (SELECT *, min(match_rank) OVER (PARTITION BY term, label) AS m FROM c) WHERE m >= 3 OR match_rank < 3)"""


def _found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sources = spark.createDataFrame([("s0", 0), ("s1", 1), ("s2", 2)], "source string, priority int")
    routes = spark.createDataFrame([("Cell", "CL", 0), ("Cell", "GO", 1)], "label string, prefix string, route_rank int")
    terms = _terms(spark, sf).withColumn("label", F.coalesce("label", F.lit("")))
    return terms, lexicon.candidates(terms, _entries(spark, sf), sources, routes)


def lexicon_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that terms meet by their variants, ranked by source, route, match and variant."""
    found = _found(spark, sf)[1]
    return found.select("term", F.nullif("label", F.lit("")).alias("label"), "iri", "source", "match_type", F.concat_ws("/", "rank.priority", "rank.route_rank", "rank.match_rank", "rank.variant_rank").alias("rank"))


CANDIDATES = f"WITH {_LEX} SELECT term, label, iri, source, match_type, priority || '/' || route_rank || '/' || match_rank || '/' || variant_rank AS rank FROM f"


def lexicon_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The concept of each term, or that it has several, or none."""
    found = lexicon.lookup(*_found(spark, sf))
    return found.select("term", F.nullif("label", F.lit("")).alias("label"), "status", "iri", "candidates")


LOOKUP = f"""
WITH {_LEX}, b AS (SELECT term, label, min(iri) AS iri, count(DISTINCT iri) AS n, string_agg(DISTINCT iri, ',' ORDER BY iri) AS iris, (list(DISTINCT iri ORDER BY iri))[1:10] AS ten FROM (SELECT *, rank() OVER (PARTITION BY term, label ORDER BY priority, route_rank, match_rank, variant_rank) AS r FROM f) WHERE r = 1 GROUP BY 1, 2)
SELECT t.term, t.label, CASE WHEN n IS NULL THEN 'unmapped' WHEN n = 1 THEN 'mapped' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN iri END AS iri, CASE WHEN n > 1 THEN array_to_string(ten, ',') END AS candidates FROM (SELECT DISTINCT term, label FROM t) t LEFT JOIN b ON b.term = t.term AND b.label IS NOT DISTINCT FROM t.label
"""


def mapping_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's mapping by the first of four sources that has it."""
    parts = read(spark, sf, "part")
    stage = lambda n, name: parts.where(f"p_partkey % {n} = 0").selectExpr("p_partkey AS term", f"concat('{name}:', p_partkey) AS iri")
    return lexicon.waterfall(parts.select(F.col("p_partkey").alias("term")), [stage(11, "curated"), stage(3, "trusted"), stage(2, "remote"), stage(5, "weak")])


WATERFALL = "SELECT p_partkey AS term, CASE WHEN p_partkey % 11 = 0 THEN 'curated:' || p_partkey WHEN p_partkey % 3 = 0 THEN 'trusted:' || p_partkey WHEN p_partkey % 2 = 0 THEN 'remote:' || p_partkey WHEN p_partkey % 5 = 0 THEN 'weak:' || p_partkey END AS iri, CASE WHEN p_partkey % 11 = 0 THEN 0 WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 2 = 0 THEN 2 WHEN p_partkey % 5 = 0 THEN 3 END AS stage FROM part"


def compacted_iris(spark: SparkSession, sf: str) -> DataFrame:
    """IRIs by the longest registered namespace, there and back, and what is wrong with them."""
    prefixes = spark.createDataFrame([("OBO", "http://x/obo/"), ("CL", "http://x/obo/CL_"), ("ex", "http://y#")], "prefix string, namespace string")
    iris = read(spark, sf, "part").selectExpr("CASE p_size % 4 WHEN 0 THEN concat('http://x/obo/CL_', p_partkey) WHEN 1 THEN concat('http://x/obo/GO_', p_partkey) WHEN 2 THEN concat('http://y#', p_brand) ELSE concat('no iri ', p_size) END AS iri")
    found = lexicon.compacted(iris, prefixes)
    back = lexicon.expanded(found.where("curie is not null").select("curie"), prefixes).withColumnRenamed("iri", "back")
    return found.join(back, "curie", "left").select("iri", "curie", "back", lexicon.iri_problem(F.col("iri"), {"http://x/obo/CL_": r"CL_\d{2,}$"}).alias("problem"))


IRIS = """
WITH i AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'http://x/obo/CL_' || p_partkey WHEN 1 THEN 'http://x/obo/GO_' || p_partkey WHEN 2 THEN 'http://y#' || p_brand ELSE 'no iri ' || p_size END AS iri FROM part)
SELECT iri, CASE WHEN iri LIKE 'http://x/obo/CL_%' THEN 'CL:' || substr(iri, 17) WHEN iri LIKE 'http://x/obo/%' THEN 'OBO:' || substr(iri, 14) WHEN iri LIKE 'http://y#%' THEN 'ex:' || substr(iri, 10) END AS curie, CASE WHEN iri LIKE 'http%' THEN iri END AS back, CASE WHEN iri LIKE 'no%' THEN 'malformed' WHEN iri LIKE 'http://x/obo/CL_%' AND length(iri) < 18 THEN 'not a term' END AS problem FROM i
"""


def lexicon_namespaces(spark: SparkSession, sf: str) -> DataFrame:
    """The namespace that each source mostly has."""
    return lexicon.namespace_roles(_entries(spark, sf))


NAMESPACES = f"""
WITH {_LEX}, n AS (SELECT source, regexp_extract(iri, '^(.*[/#_])', 1) AS namespace, count(DISTINCT iri) AS n FROM e GROUP BY 1, 2)
SELECT source, first(namespace ORDER BY n DESC, namespace) AS dominant, round(max(n) / sum(n), 4) AS share, count(*) - 1 AS others FROM n GROUP BY 1
"""


def text_abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    """Short forms that documents define, but for those with two long forms."""
    text = "concat('We saw the red ', p_type, ' ring (RR', CASE WHEN p_size % 2 = 0 THEN 'R' ELSE '' END, ') and a blue body (BB), then big bags (BB) of ', p_name, ' (pn). Fast Spiking Cells (FSCs)')"
    return lexicon.abbreviations(dealt(read(spark, sf, "part"), "p_partkey").selectExpr("p_partkey", f"{text} AS text"), "p_partkey", "text")


ABBREVIATIONS = """
SELECT p_partkey, 'FSC' AS short, 'Fast Spiking Cells' AS long FROM part UNION ALL
SELECT p_partkey, 'RR', 'red ' || p_type || ' ring' FROM part WHERE p_size % 2 = 1 UNION ALL SELECT p_partkey, 'RRR', 'red ' || p_type || ' ring' FROM part WHERE p_size % 2 = 0 AND p_type ILIKE '%r%'
"""


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "part").selectExpr("p_partkey AS row", "concat('v_', lower(p_type), '_', p_partkey % 30) AS name", "concat(p_name, ' ', lower(p_type), ' externalizing score ', CASE WHEN p_size % 2 = 0 THEN 'summary' ELSE 'rated' END, ' code', cast(floor(p_partkey / 8) AS int)) AS label", "concat('t', p_size % 6) AS table", "concat('d', p_size % 2) AS domain", "'study' AS study", "concat(p_partkey % 3, '.0') AS release")
    return context.dictionary(rows)


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").join(read(spark, sf, "part"), F.col("c_custkey") == F.col("p_partkey")).selectExpr("c_custkey AS mention", "concat(p_name, ' ', CASE WHEN c_custkey % 2 = 0 THEN lower(p_type) ELSE 'external' END, CASE WHEN c_custkey % 3 = 0 THEN ' scores' ELSE '' END, ' code', cast(floor(c_custkey / 8) AS int)) AS text", "CASE WHEN c_custkey % 4 = 0 THEN 'summary' ELSE '' END AS auxiliary", "CASE WHEN c_custkey % 5 = 0 THEN 'rated externally' ELSE '' END AS context")


_CTX = """d AS (SELECT p_partkey AS row, 'v_' || lower(p_type) || '_' || p_partkey % 30 AS name, 't' || p_size % 6 AS "table", 'd' || p_size % 2 AS domain, p_partkey % 3 || '.0' AS release, list_distinct(string_split(p_name || ' ' || lower(p_type) || ' externalizing score ' || CASE WHEN p_size % 2 = 0 THEN 'summary' ELSE 'rated' END || ' code' || (p_partkey // 8), ' ')) AS tokens FROM part),
i AS (SELECT token, count(*) AS df, ln((SELECT count(*) FROM d) / count(*)) AS idf FROM (SELECT row, unnest(tokens) AS token FROM d) GROUP BY 1), st AS (SELECT token, stem FROM (SELECT token FROM i UNION SELECT unnest(['external', 'scores', 'externally'])) LEFT JOIN LATERAL (SELECT CASE token WHEN 'externalizing' THEN 'external' WHEN 'externally' THEN 'extern' WHEN 'scores' THEN 'scor' WHEN 'summary' THEN 'summary' ELSE token END AS stem) ON true)"""


def context_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """How often each word stands in a dictionary's labels, its weight and its stem."""
    return context.frequencies(_dictionary(spark, sf)).select("token", "df", F.round("idf", 6).alias("idf"))


FREQUENCIES = f"WITH {_CTX} SELECT token, df, round(idf, 6) AS idf FROM i"


def context_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """What wordings of papers name in the dictionary; no SQL: stems and folds; a test has brute force."""
    asked, rows = _asked(spark, sf), _dictionary(spark, sf)
    return context.decided(context.merged_releases(context.cued(context.scores(asked, rows), asked, rows)))


def context_cues(spark: SparkSession, sf: str) -> DataFrame:
    """what names and labels of a dictionary and wordings of papers tell: respondent, metrics, administration, items, questions."""
    rows = read(spark, sf, "part").selectExpr("p_partkey AS row", "concat('fes', CASE p_size % 3 WHEN 0 THEN '_p_' WHEN 1 THEN '_y_' ELSE '_x_' END, 'ss', CASE p_size % 4 WHEN 0 THEN '_12' WHEN 1 THEN '_dk' ELSE '_fc' END) AS name", "concat(p_name, CASE p_size % 5 WHEN 0 THEN ' total score prorated' WHEN 1 THEN ' T-Scores' WHEN 2 THEN ' number answered' ELSE '' END, CASE WHEN p_size % 7 = 0 THEN ' [Youth]' ELSE '' END, CASE WHEN p_size % 6 = 0 THEN ' one two three four five six seven eight nine ten?' ELSE '' END) AS label")
    mentions = read(spark, sf, "part").selectExpr("p_partkey AS mention", "concat(p_name, CASE WHEN p_size % 2 = 0 THEN ' parent-reported' ELSE '' END, CASE WHEN p_size % 9 = 0 THEN '?' ELSE '' END) AS text", "CASE WHEN p_size % 3 = 0 THEN 'T-score' ELSE '' END AS auxiliary", "CASE WHEN p_size % 5 = 0 THEN 'youth-rated mean of the sum scores' END AS context")
    own = context.row_cues(context.dictionary(rows))
    both = own.join(context.mention_cues(mentions), F.col("row") == F.col("mention"))
    return both.select("row", "respondent", F.array_join("metrics", ",").alias("metrics"), F.round("penalty", 6).alias("penalty"), F.round("question", 6).alias("question"), "wanted", F.array_join("asked", ",").alias("asked"), "is_question")


CUES = """
WITH p AS (SELECT *, len(list_filter(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), lambda t: length(t) > 2)) AS own FROM part),
c AS (SELECT *, own + CASE p_size % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END + CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END + 10 AS n FROM p)
SELECT p_partkey AS row, CASE WHEN p_size % 7 = 0 THEN 'youth' WHEN p_size % 3 = 0 THEN 'parent' WHEN p_size % 3 = 1 THEN 'youth' END AS respondent,
       CASE p_size % 5 WHEN 0 THEN 'prorated,sum' WHEN 1 THEN 't_score' ELSE '' END AS metrics,
       round(CASE WHEN p_size % 4 = 0 THEN -0.10 ELSE 0 END + CASE WHEN p_size % 5 = 2 OR p_size % 4 = 1 THEN -0.22 ELSE 0 END, 6)::DOUBLE AS penalty,
       round(CASE WHEN p_size % 6 = 0 THEN -0.18 + CASE WHEN n > 12 THEN least(1.0, (n - 12) / 12.0) * -0.20 ELSE 0 END ELSE 0 END, 6)::DOUBLE AS question,
       CASE WHEN p_size % 2 = 0 THEN 'parent' WHEN p_size % 5 = 0 THEN 'youth' END AS wanted,
       concat_ws(',', CASE WHEN p_size % 3 = 0 THEN 't_score' END, CASE WHEN p_size % 5 = 0 THEN 'sum,mean' END) AS asked, p_size % 9 = 0 AS is_question
FROM c
"""


def instrument_index(spark: SparkSession, sf: str) -> DataFrame:
    """Instruments that labels name, with their main table and acronym."""
    rows = read(spark, sf, "part").selectExpr("concat(CASE p_size % 4 WHEN 0 THEN 'Child Behavior Checklist' WHEN 1 THEN concat(p_name, ' Rating Scale') WHEN 2 THEN 'Income' ELSE 'Median family income of all' END, ' [Parent] (', p_brand, ')') AS label", "concat('t', p_size % 3) AS table")
    return context.instruments(rows)


INSTRUMENTS = """
WITH h AS (SELECT CASE p_size % 4 WHEN 0 THEN 'Child Behavior Checklist' ELSE p_name || ' Rating Scale' END AS head, CASE p_size % 4 WHEN 0 THEN 'CBC' ELSE 'RS' END AS acronym, 't' || p_size % 3 AS "table" FROM part WHERE p_size % 4 < 2),
c AS (SELECT lower(head) AS instrument, "table", count(*) AS n, min(acronym) AS acronym FROM h WHERE length(head) BETWEEN 12 AND 90 GROUP BY 1, 2)
SELECT instrument, first("table" ORDER BY n DESC, "table") AS "table", sum(n)::BIGINT AS rows, count(*) AS tables, CASE WHEN min(acronym) = 'CBC' THEN 'CBC' END AS acronym FROM c GROUP BY 1
"""


def release_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Releases that a paper's stated one means, rows that it has, and their order by number."""
    rows = read(spark, sf, "part").selectExpr("p_partkey", "CASE p_size % 6 WHEN 0 THEN 'release 5.1' WHEN 1 THEN '6.0' WHEN 2 THEN 'data 6.7' WHEN 3 THEN 'none' WHEN 4 THEN '10.1' END AS stated", "CASE WHEN p_size % 4 = 0 THEN '' ELSE '6.0;6.1' END AS own")
    available = F.array(*[F.lit(r) for r in ("6.1", "6.0", "legacy", "10.0")])
    found = context.release_of(F.col("stated"), available)
    ordered = F.array_join(F.transform(F.array_sort(F.transform(available, lambda r: F.struct(context.release_order(r).alias("k"), r.alias("r")))), lambda x: x["r"]), ",")
    return rows.select("p_partkey", F.array_join(found, ",").alias("search"), context.in_release(F.col("own"), F.get(found, 0)).alias("has"), ordered.alias("ordered"))


RELEASES = """
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'legacy' WHEN 1 THEN '6.0' WHEN 2 THEN '6.0,6.1' WHEN 4 THEN '10.0' ELSE '' END AS search, p_size % 4 = 0 OR p_size % 6 IN (1, 2, 3, 5) AS has, 'legacy,6.0,6.1,10.0' AS ordered FROM part
"""

QUERIES = {
    "lexicon_candidates": (lexicon_candidates, CANDIDATES),
    "lexicon_lookup": (lexicon_lookup, LOOKUP),
    "mapping_waterfall": (mapping_waterfall, WATERFALL),
    "compacted_iris": (compacted_iris, IRIS),
    "lexicon_namespaces": (lexicon_namespaces, NAMESPACES),
    "text_abbreviations": (text_abbreviations, ABBREVIATIONS),
    "context_frequencies": (context_frequencies, FREQUENCIES),
    "context_decisions": (context_decisions, None),
    "context_cues": (context_cues, CUES),
    "instrument_index": (instrument_index, INSTRUMENTS),
    "release_choice": (release_choice, RELEASES),
}
