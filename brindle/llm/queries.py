"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import centroids, decontaminate, divergence, extract, labelled, licenses, mixing, neighbours, passages, quality, simhash, tokens, toxicity, warc
from brindle.llm.storage import table


#: Labelled documents of each class that a classifier learns from at most.
PER_CLASS = 3000
#: Score from which a document is predicted to be of the class.
DECISION = 0.3


def _decided(found: DataFrame, held_out: Column) -> DataFrame:
    """The classifiers' columns; a row without an id is not held out."""
    held_out = F.coalesce(held_out, F.lit(False))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> tuple:
    known = labelled.known(labels, "toxic", labelled.remainder("doc_id", 4) != 2)
    return toxicity.fit(labelled.sample(docs, known, PER_CLASS), labelled.shares(known))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return _decided(toxicity.scores(docs, model), labelled.remainder("doc_id", 4) == 2)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND head <> page_id THEN head END AS refers_to
FROM (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS head
      FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))
"""


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = tokens.counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id").withColumn("over_limit", F.col("n_tokens") > 4096)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = labelled.known(table(spark, sf_dir, "labels"), "quality", labelled.remainder("doc_id", 5) != 0)
    model = quality.fit(labelled.sample(docs, known, PER_CLASS), labelled.shares(known))
    return _decided(quality.scores(docs, model), labelled.remainder("doc_id", 5) == 0)


#: Domains are the labels' combinations quality + 2 * toxic; their share of the words of the mix.
DOMAIN_TARGETS = [0.15, 0.8, 0.01, 0.04]
PER_DOMAIN = 2000


def domain_model(docs: DataFrame, labels: DataFrame, domain: Column, domains: int) -> mixing.Model:
    """A model of labelled documents, at most PER_DOMAIN of each domain."""
    known = labels.where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)").groupBy("doc_id").agg(F.max(domain.cast("int")).alias("label"))
    counts = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    sample = labelled.sample(docs, known, PER_DOMAIN, classes=domains)
    return mixing.fit(sample, [counts.get(k, 0) + 1 for k in range(domains)])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = domain_model(docs, table(spark, sf_dir, "labels"), F.col("quality") + 2 * F.col("toxic"), 4)
    found = mixing.rates(docs, model, DOMAIN_TARGETS)
    shares = [F.col("posterior")[k].alias(f"p{k}") for k in range(len(DOMAIN_TARGETS))]
    return found.select(F.col("id").alias("doc_id"), "n_words", *shares, "mix_rate", "mix_copies", "mix_missed")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id", "start": "start_word"})


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections").withColumnRenamed("id", "doc_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.cleaned(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH terms AS (SELECT lang, source, row_id, unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
               FROM (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS body, row_number() OVER () AS row_id FROM documents)),
     kept AS (SELECT lang, term, count(*) AS lang_n FROM terms GROUP BY ALL HAVING count(DISTINCT row_id) >= 10),
     groups AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
     counts AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n
                FROM groups g JOIN kept k ON k.lang = g.lang
                LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM terms GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
     totals AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(lang_n) OVER (PARTITION BY lang, source) AS lang_total,
                       count(*) OVER (PARTITION BY lang, source) AS v FROM counts),
     shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v)::HUGEINT AS p,
                       1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v)::HUGEINT AS q FROM totals),
     apart AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
               FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
     found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
               FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
               LEFT JOIN apart d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
               UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 10
"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clustered(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _round_sql(before: str, after: str) -> str:
    """Vectors with their nearest centroid of ``before``, and the centroids ``after`` the round."""
    near = f"""SELECT vec_id, row_id, q, k AS cluster, d AS distance FROM (
      SELECT v.*, c.k, list_sum(list_transform(list_zip(v.q, c.q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM vectors v, {before} c)
      QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, k) = 1"""
    if not after:
        return f"nearest AS ({near})"
    return f"""near_{after} AS MATERIALIZED ({near}),
     sums_{after} AS (SELECT cluster, dim, (s - ((s % n) + n) % n) // n AS m FROM (SELECT cluster, dim, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS dim FROM near_{after}) GROUP BY ALL)),
     {after} AS MATERIALIZED (SELECT k, coalesce(m.q, c.q) AS q FROM {before} c LEFT JOIN (SELECT cluster, list(m ORDER BY dim) AS q FROM sums_{after} GROUP BY cluster) m ON m.cluster = c.k)"""


OP12_SQL = f"""
WITH vectors AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS q
                 FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS k, q FROM vectors WHERE vec_id IS NOT NULL QUALIFY k < 16),
     {_round_sql("c0", "c1")},
     {_round_sql("c1", "c2")},
     {_round_sql("c2", "c3")},
     {_round_sql("c3", "")}
SELECT n.vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM nearest n JOIN c3 c ON c.k = n.cluster
"""


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.main_texts(table(spark, sf_dir, "pages"))
    return found.withColumnRenamed("id", "page_id").select("page_id", "url", "text", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": OP5_SQL, "op11_divergence": OP11_SQL, "op12_centroids": OP12_SQL}
