"""The corpus pipeline: stages over ``documents``, each one operator, each on all that the one before it kept.

Every stage but the last returns the columns of documents; the last repeats rows to meet the mix.

Defined cases: rows without a doc_id pass the stages that go by ids; null and empty texts are one group of near copies, of
which the smallest id stays; of repeated rows one stays, and texts that share an id are each judged as their own; ties
between near copies go to the smaller id; long texts are read whole; empty tables give an empty result, without labels
the toxicity of all documents is one half, without benchmark items nothing leaks; columns of any other name pass
unchanged, but for ``mix_rate`` and ``mix_copies``, which the mix sets. A stage's intermediate tables are deleted once its
result is written, and that once the next one's is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import alike, decontaminate, mixing, passages, toxicity
from brindle.llm.queries import DECISION, domain_model, toxicity_model
from brindle.llm.storage import drop, intermediates, kept, table

#: Documents of this toxicity or more are rejected, as op1 decides.
TOXIC = DECISION
#: Shares of the words of the mix: documents of low and of high quality.
QUALITY_TARGETS = [0.1, 0.9]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC stay; the classifier learns from the labels of documents."""
    return toxicity.clean(docs, toxicity_model(docs, table(spark, sf_dir, "labels")), TOXIC)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word similarity 0.8 or more, met by SimHash and by cells, stays: that with the smallest id."""
    return alike.clean(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id holds too are cut out; texts without any stay as they are."""
    return passages.clean(docs, size_col="n_chars")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each ``mix_copies`` times, with ``mix_rate`` and ``mix_copies``; no rate is below one, so targets are met by repeating."""
    model = domain_model(docs, table(spark, sf_dir, "labels"), F.col("quality"), len(QUALITY_TARGETS))
    return mixing.repeated(mixing.mixed(docs, model, QUALITY_TARGETS, least=1.0))


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", drop_leaks), ("mixing", mix)]
#: The stages learn, hash and run automata; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with intermediates(spark):
            done = kept(stage(spark, docs, sf_dir), name)
        if k:
            drop(docs)
        docs = done
    return docs
