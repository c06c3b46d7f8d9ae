"""More files and formats: run logs, lists of DOIs, dictionary exports, snapshots, XML texts, indexes, sealed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def headline(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Of a folder of run logs, one JSON object each, the fields of the one with the latest time, then path."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"), F.from_json("value", schema).alias("d"))
    return rows.where("d is not null").agg(F.max_by("d", F.struct("at", "path")).alias("d")).select("d.*")


DOI = r"10\.\d{4,9}/\S+"


def doi_lists(files: DataFrame) -> DataFrame:
    """(path, is_list) of whole files (path, text): a list if half of its lines or more are DOIs and none is prose."""
    rows = F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")
    dois = F.size(F.filter(rows, lambda x: F.trim(x).rlike(rf"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)?{DOI}$")))
    return files.select("path", (F.coalesce(dois * 2 >= F.size(rows), F.lit(False)) & (F.size(rows) > 0) & ~F.exists(rows, lambda x: F.length(x) > 200)).alias("is_list"))


def doi_table(rows: DataFrame) -> DataFrame:
    """(row, doi) of a table of strings whose DOI column is guessed: by its header, else by its cells."""
    named = [c for c in rows.columns if "doi" in c.lower()] or [c for c in rows.columns if c != "row"]
    held = F.filter(F.array(*[F.regexp_extract(F.coalesce(F.col(c), F.lit("")), f"({DOI})", 1) for c in named]), lambda x: x != "")
    return rows.select("row", F.lower(F.get(held, 0)).alias("doi")).where("doi is not null")


def renamed(rows: DataFrame, aliases: dict[str, list[str]], needed: str) -> DataFrame:
    """Columns under their canonical names: of a name's aliases, compared without case and signs, the first that the
    table has; rows without the needed one go."""
    plain = lambda c: "".join(ch for ch in c.lower() if ch.isalnum())
    have = {plain(c): c for c in reversed(rows.columns)}
    found = {name: next((have[plain(a)] for a in [name, *own] if plain(a) in have), None) for name, own in aliases.items()}
    if found[needed] is None:
        raise ValueError(f"no column for {needed}")
    picked = rows.select(*[(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if c else F.lit(None).cast("string")).alias(name) for name, c in found.items()])
    return picked.where(F.col(needed).isNotNull())


def sniffed(line: Column) -> Column:
    """The delimiter of a header: that of tab, semicolon, bar and comma that it has most of."""
    count = lambda ch: F.length(line) - F.length(F.replace(line, F.lit(ch), F.lit("")))
    ranked = F.array(*[F.struct((-count(ch)).alias("n"), F.lit(k).alias("k"), F.lit(ch).alias("ch")) for k, ch in enumerate("\t;|,")])
    return F.array_min(ranked)["ch"]


def write_snapshots(rows: DataFrame, path: str) -> None:
    """Snapshots by study and release, which readers then prune by."""
    rows.write.mode("overwrite").partitionBy("study", "release").parquet(path)


def snapshots(spark: SparkSession, path: str, study: str | None = None, releases: list[str] | None = None) -> DataFrame:
    """Snapshots of a study and of some releases; only their folders are read."""
    found = spark.read.option("basePath", path).schema(_with_partitions(spark, path)).parquet(path)
    found = found if study is None else found.where(F.col("study") == study)
    return found if releases is None else found.where(F.col("release").isin(*releases))


def _with_partitions(spark: SparkSession, path: str) -> T.StructType:
    own = [f for f in spark.read.parquet(path).schema.fields if f.name not in ("study", "release")]
    return T.StructType([*own, T.StructField("study", T.StringType()), T.StructField("release", T.StringType())])


def article_text(xml: Column) -> Column:
    """Title, paragraphs, captions and table cells of an article's XML, in its order, a line each."""
    parts = F.xpath(xml, F.lit("//article-title/text() | //abstract//p/text() | //sec/title/text() | //sec//p/text() | //caption//p/text() | //td/text() | //passage/text/text()"))
    return F.array_join(F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""), "\n")


def tei_text(xml: Column) -> Column:
    """Headings, marked, and paragraphs of a TEI text, in its order, a line each."""
    heads = F.transform(F.xpath(xml, F.lit("//body/div/head/text()")), lambda x: F.trim(x))
    every = F.transform(F.xpath(xml, F.lit("//body/div/head/text() | //body/div/p/text()")), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.transform(F.filter(every, lambda x: x != ""), lambda x: F.when(F.array_contains(heads, x), F.concat(F.lit("## "), x)).otherwise(x)), "\n")


def xml_classes(spark: SparkSession, path: str, row_tag: str = "Class") -> DataFrame:
    """(iri, label, synonyms) of an ontology's classes, read a class at a time in bounded memory."""
    schema = "_about string, label array<string>, hasExactSynonym array<string>, deprecated boolean"
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return rows.where("_about is not null and not coalesce(deprecated, false)").select(F.col("_about").alias("iri"), F.get("label", 0).alias("label"), F.coalesce("hasExactSynonym", F.array().cast("array<string>")).alias("synonyms"))


def write_index(rows: DataFrame, path: str, columns: list[str]) -> None:
    """An index as compressed tab-separated text."""
    rows.select(*columns).write.mode("errorifexists").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def codebook(rows: DataFrame, columns: list[str]) -> Column:
    """A codebook's line: cells between tabs, tabs and line breaks in them as spaces."""
    return F.concat_ws("\t", *[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ") for c in columns])


def sealed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Records as JSON with the hash of their body, keys in order."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))
    return rows.select(body.alias("body"), F.sha2(body, 256).alias("content_sha256"))


def broken_seals(rows: DataFrame) -> DataFrame:
    """Records whose body is not that of their hash."""
    return rows.where(F.sha2("body", 256) != F.col("content_sha256"))


def verdicts_for_sink(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(written, refused) verdict records: score within 0 and 1, decision of the known ones, a subject."""
    sound = F.col("score").between(0, 1) & F.col("decision").isin("allow", "warn", "block") & (F.coalesce(F.trim("subject"), F.lit("")) != "")
    marked = rows.withColumn("_ok", F.coalesce(sound, F.lit(False)))
    return marked.where("_ok").drop("_ok"), marked.where("not _ok").drop("_ok")


def occurrences(text: Column, surface: Column) -> Column:
    """Starts of a surface in a text, without overlaps."""
    pieces = F.split(F.replace(text, surface, F.lit("\u0001")), "\u0001")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("got"))
    walked = F.aggregate(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), start, lambda a, p: F.struct((a["at"] + F.length(p) + F.length(surface)).alias("at"), F.array_append(a["got"], a["at"] + F.length(p)).alias("got")))
    return F.when(surface != "", walked["got"]).otherwise(F.array().cast("array<int>"))


def repaired(text: Column, surface: Column, claimed: Column) -> Column:
    """(start, state) of a surface: as claimed, else its nearest occurrence, the earlier of two, else not found."""
    near = F.array_min(F.transform(occurrences(text, surface), lambda p: F.struct(F.abs(p - claimed).alias("far"), p.alias("p"))))
    there = F.substring(text, claimed + 1, F.length(surface)) == surface
    return F.when(there & (claimed >= 0), F.struct(claimed.alias("start"), F.lit("exact").alias("state"))).otherwise(F.struct(near["p"].alias("start"), F.when(near.isNotNull(), "span_repaired").otherwise("not_found").alias("state")))


def masked(text: Column, pattern: str) -> Column:
    """a text with every match of a pattern as a placeholder of its length, so that offsets stay."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    blank = lambda m: F.when(F.length(m) < 2, F.repeat(F.lit("_"), F.length(m))).otherwise(F.concat(F.lit("["), F.repeat(F.lit("_"), F.length(m) - 2), F.lit("]")))
    return F.array_join(F.zip_with(parts, found, lambda p, m: F.concat(F.coalesce(p, F.lit("")), F.coalesce(blank(m), F.lit("")))), "")


def plain_with_offsets(text: Column) -> Column:
    """(plain, at): a text's letters and digits in lower case, and where each of them stands in the text."""
    letters = F.filter(F.transform(F.split(text, ""), lambda c, k: F.struct(F.lower(c).alias("c"), k.alias("k"))), lambda x: x["c"].rlike("^[a-z0-9]$"))
    return F.struct(F.array_join(F.transform(letters, lambda x: x["c"]), "").alias("plain"), F.transform(letters, lambda x: x["k"]).alias("at"))


def raw_span(text: Column, quote: Column) -> Column:
    """(start, stop) in a text of a quote that it holds but for case, spaces and signs; null if it does not."""
    own = plain_with_offsets(text)
    wanted = plain_with_offsets(quote)["plain"]
    return F.element_at(F.transform(F.array(own), lambda o: F.when((wanted != "") & o["plain"].contains(wanted), F.struct(F.get(o["at"], F.instr(o["plain"], wanted) - 1).alias("start"), (F.get(o["at"], F.instr(o["plain"], wanted) + F.length(wanted) - 2) + 1).alias("stop")))), 1)
