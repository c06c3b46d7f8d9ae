"""Span queries over documents and pages, most of them beyond SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import markdown, spans
from brindle.sources.formats import masked
from brindle.sources.tables import read


def span_repair(spark: SparkSession, sf: str) -> DataFrame:
    """a document's middle word claimed seven characters from where it stands, set right."""
    docs = read(spark, sf, "documents", "doc_id", "text").where("length(text) > 0")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    middle = docs.select(F.col("doc_id").alias("id"), "text", F.try_element_at(words, F.floor(F.size(words) / 2).cast("int") + 1).alias("surface"))
    return spans.repaired(middle.withColumn("claimed", (F.instr(F.col("text"), "e") + 7).cast("int"))).withColumnRenamed("id", "doc_id")


def mask_spans(spark: SparkSession, sf: str) -> DataFrame:
    """documents with runs of capitals and addresses blanked to their length."""
    pattern = r"[A-Z]{4,}|[a-z0-9._]+@[a-z0-9]+\.[a-z]+"

    docs = read(spark, sf, "documents", "doc_id", "text").where(F.col("text").rlike(pattern))
    return docs.select("doc_id", masked(F.col("text"), pattern).alias("masked"), F.length("text").alias("length"))


def html_to_units(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs, headings and list items of pages as units of text, without scripts, styles and comments."""
    pages = read(spark, sf, "pages", "page_id", "html")
    plain = F.regexp_replace("html", r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "")
    tagged = pages.select("page_id", F.regexp_extract_all(plain, F.lit(r"(?s)<(p|h[1-6]|li|td|th)\b[^>]*>(.*?)</\1>"), F.lit(0)).alias("u"))
    units = tagged.select("page_id", F.posexplode_outer("u").alias("unit", "raw")).where("raw is not null")
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "(?s)<[^>]*>", " "), r"\s+", " "))
    return units.select("page_id", "unit", F.regexp_extract("raw", "^<([a-z0-9]+)", 1).alias("tag"), text.alias("text")).where("text != ''")


def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    """ends of sentences by language: marks before white space and a capital."""
    docs = read(spark, sf, "documents", "lang", "text")
    return docs.select("lang", F.regexp_count("text", F.lit(r"[.!?]\s+[A-Z]")).cast("long").alias("n")).groupBy("lang").agg(F.sum("n").alias("ends"))


SENTENCES = r"SELECT lang, sum(len(regexp_extract_all(text, '[.!?]\s+[A-Z]')))::BIGINT AS ends FROM documents GROUP BY 1"

def markdown_units(spark: SparkSession, sf: str) -> DataFrame:
    """what reports in Markdown claim: sentences, table rows and captions, without code, comments, lists of references and appendices."""
    form = "---\ntitle: x\n---\n# On %s\nWe saw %s in Fig. 2 there. It was\n```\nNo claim at all here.\n```\n- about %s of them et al. Then more text came.\n<!-- nor this one here -->\n\n| Name | Size | Kind |\n|---|:--:|---|\n| %s | %s | |\n| x | | y | z |\n![A figure of %s](a.png)\n**Table 3.** Sizes of all\n## References\n1. Not a claim of any kind.\n| a | b |\n| c | d |\n## End\nToo short.\nBut this is kept here\n<!-- sidecar: a.md sha256=" + "0" * 64 + " -->\nNothing is kept after that."
    size = F.col("p_size").cast("string")
    rows = read(spark, sf, "part").select("p_partkey", F.format_string(form, "p_brand", "p_name", size, "p_type", size, "p_brand").alias("text"))
    return markdown.units(rows, "p_partkey", "text").withColumnRenamed("id", "p_partkey")


MARKDOWN = """
WITH u AS (SELECT p_partkey, unnest([
  {'at': 8, 'part': 0, 'kind': 'prose', 'location': 'On ' || p_brand, 'text': 'We saw ' || p_name || ' in Fig. 2 there.'}, {'at': 8, 'part': 1, 'kind': 'prose', 'location': 'On ' || p_brand, 'text': 'It was about ' || p_size || ' of them et al. Then more text came.'},
  {'at': 14, 'part': 1, 'kind': 'table', 'location': 'On ' || p_brand, 'text': 'Name: ' || p_type || '; Size: ' || p_size}, {'at': 14, 'part': 2, 'kind': 'table', 'location': 'On ' || p_brand, 'text': 'Name: x; Kind: y'},
  {'at': 15, 'part': 0, 'kind': 'caption', 'location': 'On ' || p_brand, 'text': 'A figure of ' || p_brand}, {'at': 16, 'part': 0, 'kind': 'caption', 'location': 'On ' || p_brand, 'text': 'Table 3. Sizes of all'},
  {'at': 20, 'part': 0, 'kind': 'table', 'location': 'References', 'text': 'a: c; b: d'}, {'at': 23, 'part': 1, 'kind': 'prose', 'location': 'End', 'text': 'But this is kept here'}]) AS u FROM part)
SELECT p_partkey, u.at, u.part, u.kind, u.location, u.text FROM u
"""

QUERIES = {
    "markdown_units": (markdown_units, MARKDOWN),
    "span_repair": (span_repair, None),
    "mask_spans": (mask_spans, None),
    "html_to_units": (html_to_units, None),
    "sentence_counts": (sentence_counts, SENTENCES),
}


def aligned_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of benchmark items in documents that share a run of their words: exact, corrected or fuzzy.

    The pairs are those that quote_location_whole finds; no SQL: the alignment is a matcher's, and a test has its cases.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    from brindle.functions import quotes
    from brindle.operators.quotations import slices
    from brindle.plans.corpus import quote_location_whole

    pairs = quote_location_whole(spark, sf).select("doc_id", "item_id").distinct()
    both = pairs.join(read(spark, sf, "documents", "doc_id", "text"), "doc_id").join(read(spark, sf, "benchmark", "item_id", F.col("text").alias("quote")), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            found = [quotes.aligned(q, t) for q, t in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist())]
            status, similarity, start, stop = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(status, pa.string()), pa.array(similarity, pa.float64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["doc_id", "item_id", "status", "similarity", "start", "stop"])

    return both.select("doc_id", "item_id", "text", "quote").mapInArrow(run, "doc_id long, item_id long, status string, similarity double, start long, stop long")


QUERIES["aligned_evidence"] = (aligned_evidence, None)
