"""Small values of texts that are made from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import values as v
from brindle.sources.tables import read


def parsed_values(spark: SparkSession, sf: str) -> DataFrame:
    """Walltimes, sizes as text, last metrics and numbers of texts."""
    rows = read(spark, sf, "part").selectExpr(
        "p_partkey", "p_size", "CASE p_size % 6 WHEN 0 THEN cast(p_size AS string) WHEN 1 THEN concat(p_size, ':30') WHEN 2 THEN concat('1:', p_size, ':05') WHEN 3 THEN concat('2-', p_size % 24) WHEN 4 THEN concat('1-3:', p_size, ':09') ELSE 'UNLIMITED' END AS wall",
        "CASE p_size % 4 WHEN 0 THEN concat('loss 3\\n', p_size, '.5\\n\\n') WHEN 1 THEN concat('x\\n{\"metric\": ', p_size, ', \"n\": 1}') WHEN 2 THEN 'NaN' ELSE 'done' END AS log", "concat(p_size, '.5 of 1,2', p_size % 10, '0 and 7') AS said",
    )
    return rows.select("p_partkey", v.walltime_seconds(F.col("wall")).alias("seconds"), v.human_bytes(F.col("p_size").cast("long") * 99991).alias("bytes"), v.human_seconds(F.col("p_size").cast("long") * 97).alias("shown"), v.last_metric(F.col("log")).alias("metric"), v.largest_int(F.col("said")).alias("largest"), v.leading_number(F.col("said")).alias("leading"))


PARSED = """
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_size * 60 WHEN 1 THEN p_size * 60 + 30 WHEN 2 THEN 3600 + p_size * 60 + 5 WHEN 3 THEN 172800 + p_size % 24 * 3600 WHEN 4 THEN 86400 + 10800 + p_size * 60 + 9 END::BIGINT AS seconds,
  CASE WHEN p_size * 99991 >= 1048576 THEN printf('%.1f MB', p_size * 99991 / 1048576.0::DOUBLE) ELSE printf('%.1f KB', p_size * 99991 / 1024.0::DOUBLE) END AS bytes,
  CASE WHEN p_size * 97 >= 3600 THEN printf('%dh %02dm %02ds', p_size * 97 // 3600, p_size * 97 % 3600 // 60, p_size * 97 % 60) WHEN p_size * 97 >= 60 THEN printf('%dm %02ds', p_size * 97 // 60, p_size * 97 % 60) ELSE printf('%ds', p_size * 97) END AS shown,
  CASE p_size % 4 WHEN 0 THEN p_size + 0.5::DOUBLE WHEN 1 THEN p_size::DOUBLE END AS metric, (1200 + p_size % 10 * 10)::BIGINT AS largest, p_size + 0.5::DOUBLE AS leading FROM part
"""


def dates_and_ids(spark: SparkSession, sf: str) -> DataFrame:
    """dates of several forms in fixed width, ids by content, and UUIDs by name."""
    rows = read(spark, sf, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'yyyy/MM/dd') WHEN 2 THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") WHEN 3 THEN date_format(o_orderdate, 'dd MMM yyyy') ELSE 'soon' END AS said", "o_orderpriority AS name")
    return rows.select("o_orderkey", v.fixed_utc(v.any_time(F.col("said"))).alias("moment"), v.content_id("C", F.col("name")).alias("id"), F.length(v.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("name"))).alias("width"))


DATES = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS moment, 'C' || left(sha1(o_orderpriority), 10) AS id, 36 AS width FROM orders"


def loose_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON alone, within a fence, and cut off."""
    rows = read(spark, sf, "part").selectExpr("p_partkey", "CASE p_size % 5 WHEN 0 THEN concat('{\"a\": ', p_size, ', \"b\": [1, 2]}') WHEN 1 THEN concat('here:\\n```json\\n{\"a\": ', p_size, ', \"b\": [1]}\\n```\\nbye') WHEN 2 THEN concat('{\"a\": ', p_size, ', \"b\": [1, 2, 3') WHEN 3 THEN concat('{\"a\": ', p_size, ', \"c\": \"unfin') ELSE 'no json' END AS text")
    found = rows.select("p_partkey", v.loose_json(F.col("text"), "a int, b array<int>").alias("x"))
    return found.select("p_partkey", "x.a", F.size("x.b").alias("n"))


JSON = "SELECT p_partkey, CASE WHEN p_size % 5 < 4 THEN p_size END AS a, CASE p_size % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS n FROM part"


def wave_wordings(spark: SparkSession, sf: str) -> DataFrame:
    """waves of wordings: baseline, follow-ups, times, years, spans, and what can't be told."""
    text = "CASE p_size % 8 WHEN 0 THEN 'Baseline (year 1)' WHEN 1 THEN concat(p_size % 9 + 1, '-year follow-up') WHEN 2 THEN concat('Time ', p_size % 9 + 1) WHEN 3 THEN concat('year ', p_size % 9 + 1) WHEN 4 THEN 'baseline and 2-year follow-up' WHEN 5 THEN 'Time 2 3-year follow-up' WHEN 6 THEN 'wave 1 through wave 4' ELSE 'later' END"
    found = read(spark, sf, "part").selectExpr("p_partkey", f"{text} AS t").select("p_partkey", v.wave(F.col("t")).alias("w"))
    return found.select("p_partkey", F.col("w.order").alias("wave"), F.col("w.first").alias("low"), F.col("w.last").alias("high"), "w.ambiguous", "w.multiple")


WAVES = """
SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 0 WHEN 1 THEN p_size % 9 + 1 WHEN 2 THEN p_size % 9 WHEN 3 THEN p_size % 9 + 1 WHEN 5 THEN 3 END::INTEGER AS wave, CASE WHEN p_size % 8 IN (4, 6) THEN 0 END AS low, CASE p_size % 8 WHEN 4 THEN 2 WHEN 6 THEN 3 END AS high, p_size % 8 = 5 AS ambiguous, p_size % 8 IN (4, 6) AS multiple FROM part
"""


def text_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Generic spans, whose statement it is, types, windows of models, and names within names."""
    rows = read(spark, sf, "part").selectExpr(
        "p_partkey", "CASE p_size % 4 WHEN 0 THEN 'Cells' WHEN 1 THEN 'many different cells' WHEN 2 THEN concat('red ', p_name, ' cells') ELSE 'the neurons' END AS span", "CASE p_size % 3 WHEN 0 THEN 'We saw it' WHEN 1 THEN 'It was seen (Smith et al., 2019)' ELSE 'It is seen' END AS sentence", "CASE WHEN p_size % 2 = 0 THEN 'Introduction' ELSE 'Results' END AS section",
        "CASE p_size % 3 WHEN 0 THEN 'GPT-Big-2' WHEN 1 THEN 'x-big' ELSE 'other' END AS model", "CASE WHEN p_size % 4 = 0 THEN array(1) ELSE array() END AS entities", "CASE WHEN p_size % 3 = 0 THEN array(1) END AS resources", "concat('Big Data Base (BDB) ', p_brand) AS name", "concat('the base of big data', CASE WHEN p_size % 2 = 0 THEN concat(' ', p_brand) ELSE '' END) AS other",
    )
    return rows.select("p_partkey", v.generic(F.col("span"), ["cells?", "neurons?"], ["different", "new"]).alias("generic"), v.scope(F.col("section"), F.col("sentence")).alias("scope"), v.context_window(F.col("model"), [("big-2", 1000), ("big", 500)]).alias("window"), v.task_type({"entities": F.col("entities"), "resources": F.col("resources")}).alias("task"), v.holds_name(F.col("name"), F.col("other")).alias("holds"))


PREDICATES = """
SELECT p_partkey, p_size % 4 <> 2 AS generic, CASE p_size % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'cited' ELSE CASE WHEN p_size % 2 = 0 THEN 'unclear' ELSE 'own' END END AS scope, CASE p_size % 3 WHEN 0 THEN 1000 WHEN 1 THEN 500 ELSE 128000 END AS "window", CASE WHEN p_size % 4 = 0 THEN 'ner' WHEN p_size % 3 = 0 THEN 'resource' ELSE 'unknown' END AS task, p_size % 2 = 0 AS holds FROM part
"""


def document_identity(spark: SparkSession, sf: str) -> DataFrame:
    """The identity of documents, and fields by the first source that has them."""
    rows = read(spark, sf, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN concat('10.1/', c_custkey) ELSE ' ' END AS doi", "CASE WHEN c_custkey % 3 = 0 THEN c_name END AS title", "CASE WHEN c_custkey % 5 = 0 THEN '/x' END AS path", "concat('f', c_custkey) AS file", "CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE '' END AS a", "CASE WHEN c_custkey % 7 > 0 THEN c_name END AS b")
    own, field = v.identity(*[F.col(c) for c in ("doi", "title", "path", "file")]), v.harvested([("registry", F.col("a")), ("text", F.col("b"))])
    return rows.select("c_custkey", own["id"].alias("id"), own["source"].alias("id_source"), field["value"].alias("value"), field["source"].alias("value_source"))


IDENTITY = """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '10.1/' || c_custkey WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 5 = 0 THEN '/x' ELSE 'f' || c_custkey END AS id, CASE WHEN c_custkey % 2 = 0 THEN 'doi' WHEN c_custkey % 3 = 0 THEN 'paper_title' WHEN c_custkey % 5 = 0 THEN 'source_path' ELSE 'filename' END AS id_source,
  CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment WHEN c_custkey % 7 > 0 THEN c_name END AS value, CASE WHEN c_custkey % 4 = 0 THEN 'registry' WHEN c_custkey % 7 > 0 THEN 'text' END AS value_source FROM customer
"""


def text_windows(spark: SparkSession, sf: str) -> DataFrame:
    """windows of documents with their overlap, and tokens they may have."""
    docs = read(spark, sf, "documents", "doc_id", "text")
    found = docs.select("doc_id", F.explode(v.windows(F.coalesce("text", F.lit("")), 2000, 200)).alias("x"))
    return found.select("doc_id", "x.start", F.md5("x.piece").alias("hash"), v.token_estimate(F.col("x.piece")).alias("tokens"), v.chunk_size(F.lit(8000), F.col("x.start")).alias("chunk"))


WINDOWS = """
SELECT doc_id, s::INTEGER AS start, md5(substr(t, s + 1, 2000)) AS hash, ceil(length(substr(t, s + 1, 2000)) / 4)::BIGINT AS tokens, greatest(500, least(16000, floor((8000 - s) * 2)))::BIGINT AS chunk
FROM (SELECT doc_id, t, unnest(range(0, greatest(0, length(t) - 201) + 1, 1800)) AS s FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
"""


def tolerant_matches(spark: SparkSession, sf: str) -> DataFrame:
    """surfaces found whatever stands between their words, and only as whole ones."""
    rows = read(spark, sf, "part").selectExpr("p_partkey", "concat(p_name, ' (x)') AS surface", "CASE p_size % 3 WHEN 0 THEN concat('a ', upper(replace(p_name, ' ', '\\n ')), '-(X)') WHEN 1 THEN concat('pre', p_name, ' (x)') ELSE concat('see ', p_name, ' (x)y') END AS text")
    return rows.select("p_partkey", F.regexp("text", v.tolerant(F.col("surface"))).alias("found"))


TOLERANT = "SELECT p_partkey, p_size % 3 = 0 AS found FROM part"


def manifest_checks(spark: SparkSession, sf: str) -> DataFrame:
    """P5: what is wrong with the entries of a manifest."""
    from pyspark.sql import Window

    rows = read(spark, sf, "part").selectExpr("p_partkey", "CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'Bad Name' ELSE concat('n', p_partkey - p_partkey % 2 * (p_size % 2)) END AS name", "CASE p_size % 4 WHEN 0 THEN 'git' WHEN 1 THEN 'ftp' WHEN 2 THEN 'archive' END AS source", "CASE WHEN p_size % 3 = 0 THEN 'http://x' ELSE 'https://x' END AS url", "CASE WHEN p_size % 7 > 0 THEN sha1(p_name) ELSE 'zz' END AS sha")
    counted = rows.withColumn("twice", (F.col("name") != "") & (F.count(F.lit(1)).over(Window.partitionBy("name")) > 1))
    return counted.select("p_partkey", F.array_join(v.manifest_problems(F.struct("name", "source", "url", "sha"), F.col("twice")), "; ").alias("problems"))


MANIFEST = """
WITH r AS (SELECT p_partkey, p_size, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'Bad Name' ELSE 'n' || (p_partkey - p_partkey % 2 * (p_size % 2)) END AS name FROM part), c AS (SELECT *, name <> '' AND count(*) OVER (PARTITION BY name) > 1 AS twice FROM r)
SELECT p_partkey, concat_ws('; ', CASE WHEN name = '' THEN 'no name' END, CASE WHEN p_size % 4 = 3 THEN 'no source' END, CASE WHEN p_size % 5 = 1 THEN 'bad name' END, CASE WHEN twice THEN 'repeated name' END, CASE WHEN p_size % 4 = 1 THEN 'unknown source' END, CASE WHEN p_size % 3 = 0 THEN 'not https' END, CASE WHEN p_size % 7 = 0 THEN 'bad hash' END) AS problems FROM c
"""

QUERIES = {
    "parsed_values": (parsed_values, PARSED),
    "dates_and_ids": (dates_and_ids, DATES),
    "loose_json": (loose_json, JSON),
    "wave_wordings": (wave_wordings, WAVES),
    "text_predicates": (text_predicates, PREDICATES),
    "document_identity": (document_identity, IDENTITY),
    "text_windows": (text_windows, WINDOWS),
    "tolerant_matches": (tolerant_matches, TOLERANT),
    "manifest_checks": (manifest_checks, MANIFEST),
}
