"""what a Markdown text claims: prose sentences, table rows and captions, by lines as rows and windows over a text's lines.

Lines are told apart once. What is in code, a comment, the front matter, behind an appendix or below the heading of the
references is no claim; a table's rows below it are. A paragraph is a run of plain lines, a table one of table lines, and
both are aggregated by the number of lines that are none of theirs before them. A window holds the lines of one text; texts
are dealt out before they are cut into lines, so that lines are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.shared import dealt

# The line that begins an appendix; headings of references; what begins a caption; abbreviations whose dot
# ends no sentence; words that a sentence needs.
APPENDIX = r"^<!-- sidecar: \S+ sha256=[0-9a-f]{64} -->$"
REFERENCES = r"(?i)^(\d+\.?\s*)?(references|bibliography)\b"
IMAGE = r"^!\[([^\]]*)\]\([^)]*\)"
CAPTION = r"^\*\*(Figure|Table)\s*\d*\.?\*\*"
BULLET = r"^[-*>]\s+|^\d+\.\s+"
SEPARATOR = r"^:?-{2,}:?$"
ABBREVIATIONS = ["et al", r"e\.g", r"i\.e", "vs", "fig", "figs", "approx", "ca", "cf", "no", "nos", "ref", "refs", "sec", "eq", "[A-Z]"]
WORDS = 3


def lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k, s, kind, heading, listed) of the lines that count; heading is the last one before, listed if it is of references."""
    whole_texts = dealt(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    each = whole_texts.select("id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("k", "raw")).select("id", "k", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")).alias("s"))
    before = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("id")
    opens = F.max(F.when((F.col("k") == 0) & (F.col("s") == "---"), True)).over(whole)
    closes = F.coalesce(F.min(F.when((F.col("k") > 0) & (F.col("s") == "---"), F.col("k"))).over(whole), F.lit(0))
    body = each.withColumns({"_from": F.when(opens, closes).otherwise(-1), "_appendix": F.min(F.when(F.col("s").rlike(APPENDIX), F.col("k"))).over(whole)})
    body = body.where("k > _from and (_appendix is null or k < _appendix)")
    fence = F.col("s").startswith("```")
    body = body.withColumn("_fences", F.count_if(fence).over(before)).where(~fence & (F.col("_fences") % 2 == 0) & ~F.col("s").startswith("<!--"))
    heading = F.trim(F.regexp_replace("s", "^#+", ""))
    kind = F.when(F.col("s").startswith("|"), "table").when(F.col("s").startswith("#"), "heading").when(F.col("s") == "", "blank").when(F.col("s").rlike(IMAGE), "image").when(F.col("s").rlike(CAPTION), "caption").otherwise("text")
    told = body.withColumn("kind", kind).withColumn("heading", F.coalesce(F.last(F.when(F.col("kind") == "heading", heading), ignorenulls=True).over(before), F.lit("")))
    # Below the references lines say nothing, and end nothing but a table.
    return told.select("id", "k", "s", "kind", "heading", (F.col("heading").rlike(REFERENCES) & ~F.col("kind").isin("table", "heading")).alias("listed"))


def sentences(text: Column) -> Column:
    """Sentences of a paragraph: they end at a mark before white space and a capital, a bracket or a star, but for abbreviations."""
    held = F.regexp_replace(text, rf"(?i)\b({'|'.join(ABBREVIATIONS)})\.", "$1\u2024")
    parts = F.split(F.regexp_replace(held, r"(?<=[.!?])\s+(?=[A-Z(\[*])", "\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda p: F.trim(F.replace(p, F.lit("\u2024"), F.lit(".")))), lambda p: p != "")


def units(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, part, kind, location, text) of a text's claims in order: ``at`` is a claim's line, the last of a paragraph or table."""
    own = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    told = lines(texts, id_col, text_col)
    told = told.withColumns({"_table": F.count_if(F.col("kind") != "table").over(own), "_prose": F.count_if((F.col("kind") != "text") & ~F.col("listed")).over(own)})
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("k", c.alias("v")))), lambda x: x["v"])
    prose = told.where("kind = 'text' and not listed").groupBy("id", "_prose").agg(F.max("k").alias("at"), F.first("heading").alias("location"), F.array_join(ordered(F.regexp_replace("s", BULLET, "")), " ").alias("text"))
    said = prose.select("id", "at", F.posexplode(sentences(F.col("text"))).alias("part", "text"), "location").where(F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))) >= WORDS)
    cells = F.transform(F.split(F.regexp_replace("s", r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    tables = told.where("kind = 'table'").groupBy("id", "_table").agg(F.max("k").alias("at"), F.first("heading").alias("location"), ordered(cells).alias("rows"))
    rows = tables.where(F.size("rows") >= 2).select("id", "at", "location", F.get("rows", 0).alias("head"), F.posexplode(F.slice("rows", 2, F.size("rows") - 1)).alias("part", "row")).where(~F.forall("row", lambda c: c.rlike(SEPARATOR)))
    both = F.slice(F.arrays_zip(F.col("head").alias("h"), F.col("row").alias("c")), F.lit(1), F.least(F.size("head"), F.size("row")))
    shown = F.array_join(F.transform(F.filter(both, lambda x: x["c"] != ""), lambda x: F.concat(x["h"], F.lit(": "), x["c"])), "; ")
    caption = F.when(F.col("kind") == "image", F.trim(F.regexp_extract("s", IMAGE, 1))).otherwise(F.replace("s", F.lit("**"), F.lit("")))
    captions = told.where("kind in ('image', 'caption') and not listed").select("id", F.col("k").alias("at"), F.lit(0).alias("part"), F.lit("caption").alias("kind"), F.col("heading").alias("location"), caption.alias("text")).where("text != ''")
    columns = ["id", "at", "part", "kind", "location", "text"]
    return said.withColumn("kind", F.lit("prose")).select(columns).unionByName(rows.select("id", "at", "part", F.lit("table").alias("kind"), "location", shown.alias("text"))).unionByName(captions)
