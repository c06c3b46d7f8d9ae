"""Files written to the shared folder and read back, and texts in other formats; oracles are the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources import files, formats, turtle
from brindle.sources.shared import dealt, shared_dir, written
from brindle.sources.tables import read


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/brindle/{name}-{uuid.uuid4().hex}"


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A table with every cell quoted, in the contract's order, read back; empty and missing cells are one."""
    path = _path(spark, "csv")
    rows = read(spark, sf, "customer").selectExpr("cast(c_custkey AS string) AS id", "concat('a \"', c_name, '\", b') AS name", "CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'NA' END AS cell")
    files.write_csv(rows, path, ["name", "id", "cell"])
    return files.csv_table(spark, path, ["name", "id", "cell"])


CSV = "SELECT c_custkey::VARCHAR AS id, 'a \"' || c_name || '\", b' AS name, CASE WHEN c_custkey % 3 = 1 THEN 'NA' ELSE '' END AS cell FROM customer"


def json_files(spark: SparkSession, sf: str) -> DataFrame:
    """One object a file, with a run's own outputs and files that hold none left out."""
    path = _path(spark, "json")
    text = "CASE n_nationkey % 5 WHEN 0 THEN 'not json' ELSE concat('{\"name\": \"', n_name, '\", \"n\": ', n_nationkey, '}') END"
    read(spark, sf, "nation").selectExpr("n_nationkey AS id", f"{text} AS value").write.partitionBy("id").text(path)
    found, _ = files.json_documents(spark, f"{path}/*/*.txt", "name string, n int")
    return found.select("name", "n")


JSONS = "SELECT n_name AS name, n_nationkey AS n FROM nation WHERE n_nationkey % 5 > 0"


def results_log(spark: SparkSession, sf: str) -> DataFrame:
    """A tab-separated log of results with its types; what doesn't parse is null."""
    path = _path(spark, "log")
    rows = read(spark, sf, "events").selectExpr("cast(event_id AS string) AS iteration", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS timestamp_utc", "upper(event_type) AS status", "CASE event_id % 4 WHEN 0 THEN 'nan' WHEN 1 THEN 'x' ELSE cast(event_id AS string) END AS metric_value")
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return files.results_log(spark, path).select("iteration", F.to_date("ts").alias("day"), "status", "metric")


LOG = "SELECT event_id::INTEGER AS iteration, ts::DATE AS day, event_type AS status, CASE WHEN event_id % 4 > 1 THEN event_id::DOUBLE END AS metric FROM events"


def usage_peak(spark: SparkSession, sf: str) -> DataFrame:
    """The peak of a stream of JSON lines, broken ones passed over."""
    path = _path(spark, "usage")
    read(spark, sf, "events").selectExpr("CASE event_id % 3 WHEN 0 THEN concat('{\"rss\": ', event_id, '}') WHEN 1 THEN concat('{\"peak_rss\": ', event_id * 2, ', \"pcpu\": ', user_id, '}') ELSE 'broken' END AS value").write.text(path)
    return files.peak_usage(spark, path)


USAGE = "SELECT max(CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN event_id * 2 END) AS peak_rss, max(CASE WHEN event_id % 3 = 1 THEN user_id::DOUBLE END) AS peak_pcpu FROM events"


def run_headline(spark: SparkSession, sf: str) -> DataFrame:
    """The headline of a run's log."""
    path = _path(spark, "run")
    read(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("top")).selectExpr("concat('{\"n\": ', n, ', \"top\": ', top, ', \"more\": [1]}') AS value").coalesce(1).write.text(path)
    return formats.headline(spark, f"{path}/*.txt", "n long, top long")


HEADLINE = "SELECT count(*) AS n, max(o_orderkey) AS top FROM orders"


def doi_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Files that are lists of DOIs, and DOIs of a table by its header."""
    rows = read(spark, sf, "customer").selectExpr("c_custkey AS row", "concat('see https://doi.org/10.5555/A', c_custkey) AS `The DOI`", "'x' AS other", "CASE c_custkey % 4 WHEN 0 THEN concat('10.5555/a\\ndoi: 10.5555/b\\n\\nnotes') WHEN 1 THEN concat('10.5555/a\\n', repeat('long prose ', 30)) WHEN 2 THEN 'a\\nb\\n10.5555/c' ELSE '' END AS text")
    lists = formats.doi_lists(rows.withColumnRenamed("row", "path").select("path", "text")).withColumnRenamed("path", "row")
    return formats.doi_table(rows.select("row", "The DOI", "other")).join(lists, "row")


DOIS = "SELECT c_custkey AS row, '10.5555/a' || c_custkey AS doi, c_custkey % 4 = 0 AS is_list FROM customer"


def dictionary_export(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary's columns by their aliases, in snapshots of which one study and release are read."""
    rows = read(spark, sf, "part").selectExpr("p_name AS `Variable Name`", "p_type AS Description", "CASE WHEN p_size % 9 = 0 THEN ' ' ELSE p_brand END AS element_name", "concat('s', p_size % 3) AS study", "concat(p_size % 2, '.0') AS release")
    found = formats.renamed(rows, {"name": ["element name", "variable_name"], "label": ["title", "description"], "study": [], "release": [], "units": ["unit"]}, "name")
    path = _path(spark, "snapshots")
    formats.write_snapshots(found, path)
    header = F.concat_ws(";", F.lit("a"), F.lit("b,c"), F.lit("d"))
    return formats.snapshots(spark, path, "s1", ["1.0"]).select("name", "label", "units", "study", "release", formats.sniffed(header).alias("delimiter"))


EXPORT = "SELECT p_brand AS name, p_type AS label, NULL::VARCHAR AS units, 's1' AS study, '1.0' AS release, ';' AS delimiter FROM part WHERE p_size % 9 > 0 AND p_size % 3 = 1 AND p_size % 2 = 1"


def triple_files(spark: SparkSession, sf: str) -> DataFrame:
    """A graph written as N-Triples and read back; comments and broken lines are passed over."""
    path = _path(spark, "graph")
    rows = read(spark, sf, "customer").selectExpr("concat('http://x/c', c_custkey) AS s", "'http://x/in' AS p", "CASE WHEN c_custkey % 2 = 0 THEN concat('http://x/n', c_nationkey) ELSE concat('\"', c_name, ' \\\\\"q\\\\\"\"') END AS o")
    files.write_n_triples(rows, path)
    return files.n_triples(spark, f"{path}/*.txt")


TRIPLES = r"""SELECT 'http://x/c' || c_custkey AS s, 'http://x/in' AS p, CASE WHEN c_custkey % 2 = 0 THEN 'http://x/n' || c_nationkey ELSE '"' || c_name || ' \"q\""' END AS o FROM customer"""


def turtle_graph(spark: SparkSession, sf: str) -> DataFrame:
    """A graph in Turtle, with prefixes, blank nodes, lists and typed literals, read, written as Turtle and read again."""
    form = "@prefix x: <http://x/> .\n# customer %s\nx:c%s a x:Customer ; x:name \"%s\"@en, '''it's \"%s\"''' ; x:balance %se0 ; x:key %s ;\n  x:at [ x:nation x:n%s ; x:good %s ] ; x:tags ( x:%s \"%s\"^^x:tag ) ;\n."
    key = F.col("c_custkey").cast("string")
    good = F.when(F.col("c_acctbal") > 0, "true").otherwise("false")
    text = F.format_string(form, key, key, "c_name", key, F.col("c_acctbal").cast("string"), key, F.col("c_nationkey").cast("string"), good, F.lower("c_mktsegment"), (F.col("c_custkey") % 7).cast("string"))
    source, copy = _path(spark, "turtle"), _path(spark, "turtle")
    read(spark, sf, "customer").select(text.alias("value")).write.option("maxRecordsPerFile", turtle.SUBJECTS).text(source)
    turtle.write_turtle(turtle.graph_files(spark, f"{source}/*.txt"), copy)
    found = written(turtle.graph_files(spark, f"{copy}/*.txt").where("problem is null").select("s", "p", "o"), "triples")
    inner = found.where("s like '_:%'").select(F.col("s").alias("b"), F.col("p").alias("q"), F.col("o").alias("v"))
    bare = found.where("s not like '_:%'").join(inner, F.col("o") == F.col("b"), "left")
    # A blank node is told by what it leads to; the rest of a list, a blank node again, by its first.
    rest = inner.select(F.col("b").alias("r"), F.col("v").alias("w")).where(F.col("q") == turtle.RDF + "first")
    told = bare.join(rest, F.col("v") == F.col("r"), "left")
    return told.select("s", "p", F.when(F.col("b").isNull(), F.col("o")).otherwise(F.concat(F.lit("["), F.regexp_replace("q", "^.*[#/]", ""), F.lit(" "), F.coalesce("w", "v"), F.lit("]"))).alias("o"))


TURTLE = """
WITH c AS (SELECT *, 'http://x/c' || c_custkey AS s FROM customer)
SELECT s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'http://x/Customer' AS o FROM c UNION ALL SELECT s, 'http://x/name', '"' || c_name || '"@en' FROM c
UNION ALL SELECT s, 'http://x/name', '"it''s \\"' || c_custkey || '\\""' FROM c UNION ALL SELECT s, 'http://x/balance', '"' || c_acctbal || 'e0"^^<http://www.w3.org/2001/XMLSchema#double>' FROM c
UNION ALL SELECT s, 'http://x/key', '"' || c_custkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>' FROM c UNION ALL SELECT s, 'http://x/at', '[nation http://x/n' || c_nationkey || ']' FROM c
UNION ALL SELECT s, 'http://x/at', '[good "' || CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END || '"^^<http://www.w3.org/2001/XMLSchema#boolean>]' FROM c
UNION ALL SELECT s, 'http://x/tags', '[first http://x/' || lower(c_mktsegment) || ']' FROM c UNION ALL SELECT s, 'http://x/tags', '[rest "' || c_custkey % 7 || '"^^<http://x/tag>]' FROM c
"""


def article_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of articles in two forms of XML, with headings, captions and tables in their order."""
    rows = dealt(read(spark, sf, "part"), "p_partkey").selectExpr("p_partkey", "concat('<article><front><article-title>On ', p_name, '</article-title><abstract><p>We  saw</p></abstract></front><body><sec><title>Methods</title><p>Used ', p_brand, '</p><fig><caption><p>Fig ', p_size, '</p></caption></fig><table><tr><td>1</td><td>2</td></tr></table></sec></body></article>') AS jats", "concat('<TEI><text><body><div><head>Intro</head><p>', p_name, '  here</p></div><div><head>End</head><p>', p_type, '</p></div></body></text></TEI>') AS tei")
    return rows.select("p_partkey", formats.article_text(F.col("jats")).alias("article"), formats.tei_text(F.col("tei")).alias("tei"))


ARTICLES = "SELECT p_partkey, 'On ' || p_name || chr(10) || 'We saw' || chr(10) || 'Methods' || chr(10) || 'Used ' || p_brand || chr(10) || 'Fig ' || p_size || chr(10) || '1' || chr(10) || '2' AS article, '## Intro' || chr(10) || p_name || ' here' || chr(10) || '## End' || chr(10) || p_type AS tei FROM part"


def ontology_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of an ontology in XML, without those that are deprecated."""
    path = _path(spark, "owl")
    rows = read(spark, sf, "part").selectExpr("concat('http://x/', p_partkey) AS _about", "p_name AS label", "CASE WHEN p_size % 2 = 0 THEN array(p_brand, 'b') END AS hasExactSynonym", "CASE WHEN p_size % 5 = 0 THEN true END AS deprecated")
    rows.write.format("xml").option("rootTag", "RDF").option("rowTag", "Class").save(path)
    return formats.xml_classes(spark, path).select("iri", "label", F.array_join("synonyms", ",").alias("synonyms"))


CLASSES = "SELECT 'http://x/' || p_partkey AS iri, p_name AS label, CASE WHEN p_size % 2 = 0 THEN p_brand || ',b' ELSE '' END AS synonyms FROM part WHERE p_size % 5 > 0"


def index_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A compressed index, appended to, and a codebook's lines."""
    path = _path(spark, "index")
    rows = read(spark, sf, "part").selectExpr("cast(p_partkey AS string) AS key", "p_name AS label", "concat(p_brand, '\\t', p_type) AS note")
    formats.write_index(rows, path, ["key", "label"])
    rows.limit(0).select("key", "label").write.mode("append").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    back = files.csv_table(spark, path, ["key", "label"], "\t")
    return back.join(rows.select("key", formats.codebook(rows, ["label", "note"]).alias("line")), "key")


INDEX = "SELECT p_partkey::VARCHAR AS key, p_name AS label, p_name || chr(9) || p_brand || ' ' || p_type AS line FROM part"


def sealed_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records with the hash of their body, those that were changed, and verdicts that a sink refuses."""
    path = _path(spark, "sealed")
    rows = read(spark, sf, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 4 > 0 THEN c_name ELSE ' ' END AS subject", "c_nationkey / 20e0 AS score", "CASE c_custkey % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'warn' ELSE 'maybe' END AS decision")
    kept, _ = formats.verdicts_for_sink(rows)
    formats.sealed(kept, ["subject", "id"]).write.mode("errorifexists").parquet(path)
    found = spark.read.parquet(path)
    changed = found.withColumn("body", F.when(F.get_json_object("body", "$.id").cast("long") % 5 == 0, F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    return formats.broken_seals(changed).select(F.get_json_object("body", "$.id").cast("long").alias("id"))


SEALED = "SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 > 0 AND c_nationkey <= 20 AND c_custkey % 3 < 2 AND c_custkey % 5 = 0"


def spans_set_right(spark: SparkSession, sf: str) -> DataFrame:
    """claimed spans set right, masked texts of the same length, and quotes found through their letters."""
    rows = read(spark, sf, "part").selectExpr("p_partkey", "concat('a ', p_name, ' and ABCD ', p_name, '; B-', p_brand) AS text", "CASE WHEN p_size % 5 = 0 THEN 'nowhere' ELSE p_name END AS surface", "cast(CASE p_size % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 30 END AS int) AS claimed", "concat('AND  abcd', CASE WHEN p_size % 2 = 0 THEN '-' ELSE '!x' END) AS quote")
    fixed, span = formats.repaired(F.col("text"), F.col("surface"), F.col("claimed")), formats.raw_span(F.col("text"), F.col("quote"))
    return rows.select("p_partkey", fixed["start"].alias("start"), fixed["state"].alias("state"), formats.masked(F.col("text"), "[A-Z]{4,}|B").alias("masked"), span["start"].alias("q_start"), span["stop"].alias("q_stop"))


SPANS = """
WITH p AS (SELECT *, length(p_name) AS n FROM part)
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 2 WHEN p_size % 3 = 1 THEN 2 ELSE CASE WHEN abs(2 - 30) <= abs(n + 12 - 30) THEN 2 ELSE n + 12 END END::INTEGER AS start, CASE WHEN p_size % 5 = 0 THEN 'not_found' WHEN p_size % 3 = 0 OR (p_size % 3 = 2 AND n + 12 = 30) THEN 'exact' ELSE 'span_repaired' END AS state,
  'a ' || p_name || ' and [__] ' || p_name || '; _-' || replace(p_brand, 'B', '_') AS masked, CASE WHEN p_size % 2 = 0 THEN n + 3 END::INTEGER AS q_start, CASE WHEN p_size % 2 = 0 THEN n + 11 END::INTEGER AS q_stop FROM p
"""

QUERIES = {
    "turtle_graph": (turtle_graph, TURTLE),
    "csv_round_trip": (csv_round_trip, CSV),
    "json_files": (json_files, JSONS),
    "results_log": (results_log, LOG),
    "usage_peak": (usage_peak, USAGE),
    "run_headline": (run_headline, HEADLINE),
    "doi_inputs": (doi_inputs, DOIS),
    "dictionary_export": (dictionary_export, EXPORT),
    "triple_files": (triple_files, TRIPLES),
    "article_texts": (article_texts, ARTICLES),
    "ontology_classes": (ontology_classes, CLASSES),
    "index_round_trip": (index_round_trip, INDEX),
    "sealed_records": (sealed_records, SEALED),
    "spans_set_right": (spans_set_right, SPANS),
}
