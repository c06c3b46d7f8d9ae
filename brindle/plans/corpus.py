"""Queries over documents, pages, labels and benchmark: index, status, duplicates, locations, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.operators import entities
from brindle.operators.quotations import located
from brindle.operators.similar import overlapping
from brindle.sources.shared import spread, tasks
from brindle.sources.tables import read


def corpus_token_index(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of three letters or more, by language, in two documents or more, most frequent first."""
    docs = read(spark, sf, "documents", "doc_id", "lang", "text")
    mentions = docs.select("doc_id", "lang", F.explode(tx.tokens(F.col("text"))).alias("token")).where(F.length("token") > 2)
    index = entities.cross_document_index(mentions, ["token", "lang"], "doc_id")
    return index.where("document_count >= 2")


TOKEN_INDEX = """
WITH t AS (SELECT doc_id, lang, unnest(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) AS token FROM documents)
SELECT token, lang, count(*) AS mention_count, count(DISTINCT doc_id) AS document_count
FROM t WHERE length(token) > 2 GROUP BY token, lang HAVING count(DISTINCT doc_id) >= 2
"""


def document_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status of every document by its label, with the number of documents of that status."""
    docs, labels = read(spark, sf, "documents", "doc_id", "n_chars"), read(spark, sf, "labels")
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "low").otherwise("unlabelled")
    return docs.join(labels, "doc_id", "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


STATUS = """
SELECT CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' WHEN quality = 0 THEN 'low' ELSE 'unlabelled' END AS status,
       count(*) AS documents, sum(n_chars)::BIGINT AS chars
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1
"""


def unlabelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without a label."""
    return read(spark, sf, "documents", "doc_id", "source", "n_chars").join(read(spark, sf, "labels", "doc_id"), "doc_id", "left_anti")


UNLABELLED = "SELECT doc_id, source, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"


def source_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and bytes by source, unknown ones together."""
    docs = read(spark, sf, "documents", "source", "text")
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source")
    return docs.groupBy(source).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


BREAKDOWN = "SELECT coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS documents, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1"


def hash_dupes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share their text's hash: how many there are and the first of them."""
    docs = read(spark, sf, "documents", "doc_id", "text")
    by_hash = docs.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.listagg(F.col("doc_id").cast("string"), F.lit(",")).alias("members"))
    ordered = F.array_join(F.transform(F.array_sort(F.transform(F.split("members", ","), lambda x: x.cast("long"))), lambda x: x.cast("string")), ",")
    return by_hash.where("copies > 1").withColumn("members", ordered)


DUPES = """
SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members
FROM documents GROUP BY 1 HAVING count(*) > 1
"""


def identity_collision_suffix(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by host; from the second of a host on, its number is added to the name."""
    pages = read(spark, sf, "pages", "page_id", "url")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return entities.numbered(pages.select("page_id", host.alias("host")), ["host"], F.col("host"), F.asc("page_id"))


COLLISION = """
SELECT page_id, host, CASE WHEN n > 1 THEN host || ' #' || n ELSE host END AS document_id
FROM (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n
      FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages))
"""


def top_k_with_other(spark: SparkSession, sf: str) -> DataFrame:
    """The five sources with most documents, and all others together."""
    counts = read(spark, sf, "documents", "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return entities.top_with_other(counts, "source", "n", 5)


TOP_OTHER = """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS k FROM c)
SELECT CASE WHEN k <= 5 THEN source ELSE 'Other' END AS source, sum(n)::BIGINT AS n FROM r GROUP BY 1
"""


def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different texts whose sampled five-word shingles overlap by half or more of the smaller set.

    Equal texts are one entry, named by its smallest id, as near_duplicate_members tells: hashes of texts are grouped, not
    the texts, which are dealt out by their bytes once for their sets, so that a task holds as much of a large table as of a
    small one.
    """
    texts = read(spark, sf, "documents", "doc_id", "text").where("text is not null")
    first = spread(texts, "doc_id").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    every = texts.repartition(tasks(texts, texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0], 8 << 20), "doc_id")
    words = every.join(first, "doc_id", "left_semi").select("doc_id", tx.tokens(F.col("text")).alias("w"))
    five = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda k: F.array_join(F.slice("w", k, F.lit(5)), " "))
    # The sample of one in eight is by the last of the digits that make the number.
    hashed = words.where(F.size("w") >= 5).select("doc_id", F.explode(five).alias("s")).select("doc_id", F.substring(F.md5("s"), 1, 8).alias("x")).where(F.substring("x", 8, 1).isin("0", "8"))
    sets = hashed.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.conv("x", 16, 10).cast("long")).alias("s"))
    found = overlapping(sets, 0.5)
    return found.select(F.least("a", "b").alias("doc_id"), F.greatest("a", "b").alias("other_id"), F.col("shared").cast("long"), F.round(F.col("shared") / F.col("smaller"), 4).alias("overlap"))


NEAR = """
WITH d AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text),
l AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM d),
t AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM l),
g AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT AS h FROM g WHERE s IS NOT NULL AND ('0x' || substr(md5(s), 1, 8))::BIGINT % 8 = 0),
c AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (SELECT a.doc_id, b.doc_id AS other_id, count(*) AS shared FROM h a JOIN h b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT p.doc_id, p.other_id, shared, round(shared / least(c.n, e.n), 4) AS overlap
FROM p JOIN c ON c.doc_id = p.doc_id JOIN c e ON e.doc_id = p.other_id WHERE shared * 2 >= least(c.n, e.n)
"""


def near_duplicate_members(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the representative of its text, by which near_duplicates names it; equal texts share one."""
    docs = read(spark, sf, "documents", "doc_id", "text")
    key = F.sha2(F.col("text"), 256)
    least = docs.groupBy(key.alias("key")).agg(F.min("doc_id").alias("representative"))
    basis = F.when(F.col("doc_id") == F.col("representative"), "representative").otherwise("identical text")
    return docs.select("doc_id", key.alias("key")).join(least, "key").select("doc_id", "representative", basis.alias("basis"))


MEMBERS = """
SELECT doc_id, representative, CASE WHEN doc_id = representative THEN 'representative' ELSE 'identical text' END AS basis
FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS representative FROM documents) WHERE text IS NOT NULL
"""


def relevance_top1_idf(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark item that each document covers best, by IDF-weighted token coverage."""
    docs = read(spark, sf, "documents", "doc_id", "text")
    items = read(spark, sf, "benchmark", "item_id", "text")
    item_tokens = items.select("item_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token")).where(F.length("token") > 2)
    n = items.count()
    idf = item_tokens.groupBy("token").agg(F.log(F.lit(n) / F.count(F.lit(1))).alias("idf"))
    weighted = item_tokens.join(idf, "token")
    total = weighted.groupBy("item_id").agg(F.sum("idf").alias("total"))
    doc_tokens = docs.select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token"))
    hits = doc_tokens.join(weighted, "token").groupBy("doc_id", "item_id").agg(F.sum("idf").alias("hit"))
    scored = hits.join(total, "item_id").where("total > 0").select("doc_id", "item_id", F.round(F.col("hit") / F.col("total"), 4).alias("coverage"))
    return entities.best_per_key(scored.where("coverage >= 0.5"), ["doc_id"], F.desc("coverage"), F.asc("item_id"))


RELEVANCE = """
WITH it AS (SELECT DISTINCT item_id, unnest(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) AS token FROM benchmark),
i AS (SELECT * FROM it WHERE length(token) > 2),
f AS (SELECT token, ln((SELECT count(*) FROM benchmark) / count(*)) AS idf FROM i GROUP BY token),
w AS (SELECT item_id, token, idf FROM i JOIN f USING (token)),
s AS (SELECT item_id, sum(idf) AS total FROM w GROUP BY item_id),
d AS (SELECT DISTINCT doc_id, unnest(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) AS token FROM documents),
h AS (SELECT doc_id, item_id, sum(idf) AS hit FROM d JOIN w USING (token) GROUP BY 1, 2),
c AS (SELECT doc_id, item_id, round(hit / total, 4) AS coverage FROM h JOIN s USING (item_id) WHERE total > 0)
SELECT doc_id, item_id, coverage FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coverage DESC, item_id) AS k FROM c WHERE coverage >= 0.5) WHERE k = 1
"""


def quote_location_whole(spark: SparkSession, sf: str) -> DataFrame:
    """benchmark texts in documents: verbatim, in normal form, or by half or more of their six-token runs."""
    return located(read(spark, sf, "documents", "doc_id", "text"), read(spark, sf, "benchmark", "item_id", F.col("text").alias("quote")))


def quantities_and_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers with an optional percent sign in documents, and 'n of d' pairs, counted and summed."""
    docs = read(spark, sf, "documents", "doc_id", "text")
    numbers = F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)?%?"), F.lit(0))
    pairs = F.regexp_extract_all("text", F.lit(r"[0-9]+ of [0-9]+"), F.lit(0))
    found = docs.select("doc_id", numbers.alias("q"), F.size(pairs).cast("long").alias("pairs"))
    percents = F.size(F.filter("q", lambda x: x.endswith("%"))).cast("long")
    return found.select("doc_id", F.size("q").cast("long").alias("quantities"), percents.alias("percents"), "pairs").where("quantities > 0")


QUANTITIES = r"""
SELECT doc_id, len(q)::BIGINT AS quantities, len(list_filter(q, lambda x: x LIKE '%\%' ESCAPE '\'))::BIGINT AS percents, pairs
FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?%?') AS q, len(regexp_extract_all(text, '[0-9]+ of [0-9]+'))::BIGINT AS pairs FROM documents)
WHERE len(q) > 0
"""

# Rules of style and of unsafe text: code, severity or category, expression.
WRITING_RULES = [("shouting", "warning", r"[A-Z]{4,}"), ("doubled_mark", "info", r"[!?]{2,}"), ("symbol_noise", "error", r"[%&$#*]{3,}"), ("table_bar", "info", r" \| ")]
INJECTION_RULES = [("email", r"[a-z0-9._]+@[a-z0-9]+\.[a-z]+"), ("secret", r"(?i)(api_?key|password|secret|token) ?[=:]"), ("instruction", r"(?i)ignore (all |any )?previous"), ("phone", r"\+?[0-9]{3}[ -][0-9]{3,4}[ -][0-9]{3,4}"), ("address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")]


def writing_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of each rule of style over documents: how many and in how many documents."""
    docs = read(spark, sf, "documents", "text")
    counts = docs.select(*[F.regexp_count("text", F.lit(rx)).alias(code) for code, _, rx in WRITING_RULES])
    summed = counts.agg(*[F.struct(F.sum(code).alias("n"), F.sum(F.when(F.col(code) > 0, 1).otherwise(0)).alias("d")).alias(code) for code, _, _ in WRITING_RULES])
    rows = F.inline(F.array(*[F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(code)["n"].alias("findings"), F.col(code)["d"].alias("documents")) for code, severity, _ in WRITING_RULES]))
    return summed.select(rows)


WRITING = " UNION ALL ".join(f"SELECT '{code}' AS code, '{severity}' AS severity, sum(len(regexp_extract_all(text, '{rx}')))::BIGINT AS findings, count(*) FILTER (regexp_matches(text, '{rx}')) AS documents FROM documents" for code, severity, rx in WRITING_RULES)


def injection_scan(spark: SparkSession, sf: str) -> DataFrame:
    """rows of documents and turns of conversations that any unsafe-text rule hits, with counts by category."""
    docs = read(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"), "text")
    turns = read(spark, sf, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text")
    counted = docs.unionByName(turns).select("kind", "id", "part", *[F.regexp_count("text", F.lit(rx)).cast("long").alias(code) for code, rx in INJECTION_RULES])
    total = sum((F.col(code) for code, _ in INJECTION_RULES[1:]), F.col(INJECTION_RULES[0][0]))
    return counted.where(total > 0)


INJECTION = f"""
SELECT * FROM (SELECT kind, id, part, {', '.join(f"len(regexp_extract_all(text, '{rx}'))::BIGINT AS {code}" for code, rx in INJECTION_RULES)}
FROM (SELECT 'document' AS kind, doc_id AS id, 0::BIGINT AS part, text FROM documents UNION ALL SELECT 'turn', conv_id, turn, text FROM conversations))
WHERE {' + '.join(code for code, _ in INJECTION_RULES)} > 0
"""


def url_targets(spark: SparkSession, sf: str) -> DataFrame:
    """pages by typed target of their URL: host, section, and whether a query or fragment follows."""
    pages = read(spark, sf, "pages", "page_id", "url")
    part = lambda rx: F.regexp_extract("url", rx, 1)
    kind = F.when(F.col("url").contains("?"), "query").when(F.col("url").contains("#"), "anchor").otherwise("plain")
    return pages.select(part("^([a-z]+)://").alias("scheme"), part("^[a-z]+://([^/?#]+)").alias("host"), part("^[a-z]+://[^/]+/([^/?#]*)").alias("section"), kind.alias("kind")).groupBy("scheme", "host", "section", "kind").agg(F.count(F.lit(1)).alias("pages"))


URLS = """
SELECT regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS section,
       CASE WHEN contains(url, '?') THEN 'query' WHEN contains(url, '#') THEN 'anchor' ELSE 'plain' END AS kind, count(*) AS pages
FROM pages GROUP BY 1, 2, 3, 4
"""


def abbreviation_table(spark: SparkSession, sf: str) -> DataFrame:
    """Short forms of turns' first words that stand for one long form only."""
    turns = read(spark, sf, "conversations", "conv_id", "text")
    w = turns.select(F.slice(tx.tokens(F.col("text")), 1, 3).alias("w")).where(F.size("w") == 3)
    named = w.select(F.array_join(F.transform("w", lambda x: F.substring(x, 1, 1)), "").alias("short"), F.array_join("w", " ").alias("long"))
    return named.groupBy("short").agg(F.min("long").alias("long"), F.max("long").alias("_last"), F.count(F.lit(1)).alias("uses")).where(F.col("long") == F.col("_last")).drop("_last")


ABBREVIATIONS = """
WITH t AS (SELECT list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')[1:3] AS w FROM conversations),
n AS (SELECT w[1][1] || w[2][1] || w[3][1] AS short, array_to_string(w, ' ') AS long FROM t WHERE len(w) = 3)
SELECT short, min(long) AS long, count(*) AS uses FROM n GROUP BY short HAVING count(DISTINCT long) = 1
"""

QUERIES = {
    "corpus_token_index": (corpus_token_index, TOKEN_INDEX),
    "document_status": (document_status, STATUS),
    "unlabelled_documents": (unlabelled_documents, UNLABELLED),
    "source_breakdown": (source_breakdown, BREAKDOWN),
    "hash_dupes": (hash_dupes, DUPES),
    "identity_collision_suffix": (identity_collision_suffix, COLLISION),
    "top_k_with_other": (top_k_with_other, TOP_OTHER),
    "near_duplicates": (near_duplicates, NEAR),
    "near_duplicate_members": (near_duplicate_members, MEMBERS),
    "relevance_top1_idf": (relevance_top1_idf, RELEVANCE),
    "quote_location_whole": (quote_location_whole, None),
    "quantities_and_pairs": (quantities_and_pairs, QUANTITIES),
    "writing_rules": (writing_rules, WRITING),
    "injection_scan": (injection_scan, INJECTION),
    "url_targets": (url_targets, URLS),
    "abbreviation_table": (abbreviation_table, ABBREVIATIONS),
}
