"""The pipeline rejects what op1 predicts toxic."""

from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import queries, toxicity


def test_stage_decides_as_op1(spark, monkeypatch):
    docs = spark.createDataFrame([(k, str(k / 10)) for k in range(10)], "doc_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "toxicity_model", lambda *_: None)
    seen = []
    monkeypatch.setattr(toxicity, "clean", lambda rows, model, most: seen.append(most) or rows)
    corpus_pipeline.drop_toxic(spark, docs.withColumnRenamed("text", "t"), "/root/testdata/sf0.001")
    scored = docs.selectExpr("doc_id as id", "cast(text as double) as score")
    predicted = {r.doc_id: r.predicted for r in queries._decided(scored, F.col("doc_id") < 0).collect()}
    assert {k for k, toxic in predicted.items() if not toxic} == {k for k in range(10) if k / 10 < seen[0]}
