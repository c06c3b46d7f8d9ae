"""Questions over systematic reviews: what they included, read, screened and answered.

Tables (see :mod:`brindle.graph.tables`): included(review, pub), publication(pub, title, doi, pmid, abstract), artifact(art,
pub, content, bytes, hash, media, source, created, act, derived_from), activity(act, tool, ended, result_hash),
reading(review, retrieved, not_retrieved, on_full_text, on_abstract_only, included_full, included_abstract), route(review,
source, reports), exclusion(review, stage, reason, reports), screening(rec, review, stage, decision, assessed_on, pmid,
source, reason), question(q, qid, title), answer(a, q, text, source_id, pub).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

T = Mapping[str, DataFrame]


def _sources(t: T) -> DataFrame:
    """Publications with a title that a review includes."""
    return t["included"].select("pub").distinct().join(t["publication"].where("title is not null"), "pub")


def full_texts(t: T, content: bool = True) -> DataFrame:
    """G1: included sources with their full text; G2: without its content."""
    found = _sources(t).join(t["artifact"], "pub")
    found = found.where("content is not null") if content else found
    return found.select("pub", "title", "doi", "pmid", "bytes", "hash", *([F.col("content").alias("text")] if content else [])).distinct()


def abstracts_only(t: T) -> DataFrame:
    """Included sources without full text."""
    return _sources(t).join(t["artifact"].select("pub"), "pub", "left_anti").select("pub", "title", "doi", "abstract").distinct()


def statuses(t: T) -> DataFrame:
    """Whether each included source has its full text, a row for each review that includes it."""
    found = t["included"].join(t["publication"].where("title is not null"), "pub").join(t["artifact"].select("pub", "art", "bytes"), "pub", "left")
    return found.select("title", F.when(F.col("art").isNotNull(), "full_text").otherwise("abstract_only").alias("status"), "doi", "bytes")


def counts(t: T) -> DataFrame:
    """Included sources, with and without full text."""
    held = t["artifact"].select("pub", F.col("pub").alias("full")).distinct()
    found = t["included"].select("pub").distinct().join(held, "pub", "left").agg(F.count("pub").alias("included"), F.count("full").alias("full_text"))
    return found.withColumn("abstract_only", F.col("included") - F.col("full_text"))


def _artifacts(t: T) -> DataFrame:
    return t["included"].select("pub").distinct().join(t["publication"], "pub").join(t["artifact"], "pub")


def provenance(t: T) -> DataFrame:
    """Where each full text comes from."""
    return _artifacts(t).where("title is not null").select("title", "source", "hash", "bytes", "media")


def source_counts(t: T) -> DataFrame:
    """Full texts by source."""
    return _artifacts(t).groupBy(F.coalesce("source", F.lit("(unknown)")).alias("source")).agg(F.count("art").alias("n"))


def retrieval_chain(t: T) -> DataFrame:
    """The activity that got each full text."""
    found = _artifacts(t).where("title is not null and derived_from is not null").select("title", "act").join(t["activity"], "act")
    return found.select("title", F.col("tool").alias("source"), F.col("ended").alias("when"), F.col("result_hash").alias("hash"))


def reading_basis(t: T) -> DataFrame:
    """What each review read."""
    return t["reading"].select("retrieved", "not_retrieved", "on_full_text", "on_abstract_only", "included_full", "included_abstract")


def routes(t: T) -> DataFrame:
    """Reports by route."""
    return t["route"].select(F.col("source").alias("route"), "reports")


def route_articles(t: T, source: str) -> DataFrame:
    """Articles that one route got."""
    return _artifacts(t).where(F.col("source") == source).select("title", "doi", F.col("created").alias("when"))


def exclusions(t: T) -> DataFrame:
    """Reasons of exclusion by stage."""
    return t["exclusion"].where("stage in ('title_abstract', 'eligibility')").select("stage", "reason", "reports")


def decisions(t: T) -> DataFrame:
    """Screening decisions."""
    return t["screening"].select("pmid", "stage", "decision", "assessed_on", F.col("source").alias("route"), "reason")


def abstract_inclusions(t: T) -> DataFrame:
    """Sources that were included at the full-text stage on their abstract alone."""
    return t["screening"].where("stage = 'full_text' and assessed_on = 'abstract_only' and lower(decision) = 'include'").select("pmid", "reason")


def question_counts(t: T) -> DataFrame:
    """Answers to each question."""
    return t["answer"].join(t["question"], "q").groupBy("qid", "title").agg(F.count("a").alias("answers"))


def answers(t: T, qid: str) -> DataFrame:
    """Every answer to one question."""
    found = t["question"].where(F.col("qid") == qid).select("q").join(t["answer"].where("text is not null"), "q").join(t["publication"].select("pub", "pmid"), "pub", "left")
    return found.select("pmid", "source_id", F.col("text").alias("answer"))
