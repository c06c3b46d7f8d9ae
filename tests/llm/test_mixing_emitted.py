"""The pipeline's mix meets its targets by the rows that it emits."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_llm_operators import WORDS

import corpus_pipeline
from brindle.llm import mixing
from brindle.llm.queries import domain_model


def test_emitted_rows_meet_the_targets(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(WORDS) + ("%" if k % 2 and rng.random() < 0.3 else "") for _ in range(60))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(0, 600, 3)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.mix(spark, docs, str(tmp_path))
    copies = Counter(r.doc_id for r in got.collect())
    assert all(copies[r.doc_id] == r.mix_copies for r in got.collect()) and set(copies) == {k for k, _ in rows}
    model = domain_model(docs, labels, F.col("quality"), 2)
    scored = mixing.posteriors(docs, model, "text").collect()
    total = [sum(copies[r.doc_id] * r["_n"] * r["_p"][k] for r in scored) for k in (0, 1)]
    assert abs(total[1] / sum(total) - corpus_pipeline.QUALITY_TARGETS[1]) < 0.01
