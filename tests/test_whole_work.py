"""Work that grows with the rows: what a finding named is done once, in parts, or before rows meet."""

import pyarrow as pa
from pyspark.sql import functions as F
from test_growth import within

from brindle.graph import entities
from brindle.operators import citations, markdown, mentions, quotations, verdicts
from brindle.plans import registry

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_studies_are_read_once(spark):
    """links are found in what entries are told by, written; entries themselves are not read for each of them."""
    rows = spark.createDataFrame([(1, "f", "c", "", "", ""), (2, "f", "d", "", "", "")], "id long, file string, content string, doi string, pmid string, title string").withColumn("content", F.sha2("content", 256))
    assert "sha2" not in optimized(citations.duplicate_links(rows)) and "sha2" not in optimized(citations.duplicate_studies(rows))
    assert sorted(map(tuple, citations.duplicate_studies(rows).collect())) == [(1, 1, 1), (2, 1, 1)]


def test_citations_of_one_author(spark):
    """30,000 citations of an author and a year that 30,000 studies have."""
    cites = spark.range(30_000).selectExpr("id AS cite", "CAST(NULL AS long) AS pmid", "CAST(NULL AS string) AS doi", "'Name' AS surname", "2000 AS year")
    studies = spark.range(30_000).selectExpr("id + 5 AS study", "id AS pmid", "'' AS doi", "'Name J' AS authors", "'2001' AS year")
    found = within(spark, 40, lambda: citations.matched(cites, studies, spark.createDataFrame([], "pmid long, stage string")).groupBy("study", "fate").count())
    assert [tuple(r) for r in found] == [(5, "included", 30_000)]


def test_related_papers_meet_once(spark):
    """two papers of an entity meet once, not each the other."""
    tables = {"entity_source": spark.createDataFrame([(1, 7), (1, 8), (1, 9), (2, 7), (2, 8)], "e long, pub long"), "source": spark.createDataFrame([(7, "d7"), (8, None)], "pub long, doi string")}
    found = entities.related_papers(tables)
    assert "(x" in optimized(found) and "NOT (p1" not in optimized(found)
    assert sorted(map(tuple, found.collect())) == [(7, 8, "d7", None, 2), (7, 9, "d7", None, 1), (8, 7, None, "d7", 2), (8, 9, None, None, 1), (9, 7, None, "d7", 1), (9, 8, None, None, 1)]


def test_lines_of_texts_are_not_shuffled(spark):
    """a text's lines stay where the text was dealt out to."""
    texts = spark.range(50).selectExpr("id", "concat('# H\nWe saw ', id, ' of them there.') AS text").coalesce(1)
    lines = markdown.lines(texts, "id", "text")
    assert lines._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert lines.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    assert markdown.units(texts, "id", "text").count() == 50


def test_rows_of_one_file_are_dealt_out(spark):
    """Costly work on each row of a small file is not one task."""
    for name in ("article_texts", "text_quantities", "section_checks", "text_abbreviations"):
        assert "REPARTITION_BY_NUM" in registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString(), name


def test_readings_are_made_once(spark):
    """readings are made before rows are grouped twice."""
    rows = [(k, 1, e, "l", None, 0.5, m, "i", None, "tool", "s", 3, None) for k, (e, m) in enumerate([("fast-\nspiking", "a"), ("Fast-spiking", "b"), ("fast-\nspiking", ""), (" a  b ", None)])]
    df = mentions.keyed(spark.createDataFrame(rows, "position long, doc long, entity string, label string, referent string, judge_score double, source_model string, ontology_id string, ontology_label string, concept_mapping_provenance string, sentence string, start long, specificity string"))
    made = [mentions.groups(df), mentions.unified(df, ["ontology_id"]), mentions.in_order(df), mentions.corpus_index(df)]
    assert all("\\s+" not in optimized(m) for m in made)
    assert sorted((r.form, r.mention_count, r.consensus_count, r.surface) for r in made[0].collect()) == [("a b", 1, 0, "a b"), ("fast-spiking", 3, 2, "fast-spiking")]


def test_inventory_has_no_last_shuffle(spark):
    """rows are distinct before they are joined, repeated ones too."""
    make = spark.createDataFrame
    tables = {"entity_source": make([(1, 7), (1, 7)], "e long, pub long"), "entity": make([(1, "k"), (1, "k")], "e long, key string"), "entity_class": make([(1, "Drug"), (1, "Drug"), (1, "NamedEntity")], "e long, cls string"), "source": make([(7, "d"), (7, "d")], "pub long, doi string")}
    found = entities.inventory(tables)
    assert [tuple(r) for r in found.collect()] == [(7, "d", 1, "k", "Drug")] and optimized(found).startswith("Project")


def test_claims_of_few_entities(spark):
    """keys are those of entities that claims name; a claim's role is found by them."""
    make = spark.createDataFrame
    tables = {"entity": make([(k, f"k{k}") for k in range(9)] + [(1, "k1b")], "e long, key string"), "causal": make([(5, 1, 2, 7, 50)], "rel long, cause long, effect long, pub long, v long"), "causal_version": make([(50, 5, True, False)], "v long, rel long, negated boolean, hypothetical boolean"), "causal_third": make([(5, "mediator", 3)], "rel long, role string, third long")}
    found = entities.claims_of(tables)
    assert "LeftSemi" in optimized(found)
    assert sorted((r.key, r.role, r.cause_key) for r in found.collect()) == [("k1", "cause", "k1"), ("k1", "cause", "k1b"), ("k1b", "cause", "k1"), ("k1b", "cause", "k1b"), ("k2", "effect", "k1"), ("k2", "effect", "k1b"), ("k3", "mediator", "k1"), ("k3", "mediator", "k1b")]


def test_papers_are_counted_in_two_steps(spark):
    """What is distinct already is not made so once more."""
    make = spark.createDataFrame
    tables = {"entity_source": make([(1, 7), (1, 7), (1, 8)], "e long, pub long"), "source": make([(7, "2001-1"), (7, "1999-1"), (8, None)], "pub long, issued string"), "entity": make([(1, "k")], "e long, key string")}
    assert [tuple(r) for r in entities.first_seen(tables).collect()] == [(1, 1999, 1, "k")]
    claims = make([("c", 1, "positive"), ("c", 1, "positive"), ("c", 2, "negative"), ("c", 3, None), ("d", 1, "null")], "construct string, paper long, direction string")
    found = verdicts.consensus(claims)
    assert optimized(found).count("Aggregate") == 2
    assert sorted((r.construct, r.papers, r.positive, r.negative, r.neutral, r.verdict) for r in found.collect()) == [("c", 3, 1, 1, 0, "divergent"), ("d", 1, 0, 0, 1, "insufficient_papers")]


def test_texts_are_taken_apart_in_slices():
    """a task holds the tokens of a part of a batch, not of all its texts."""
    texts = ["a few words of a text " * 20_000, None, "", "one two three four five six seven", "b c d e f g h " * 90_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts)], names=["id", "text"])
    made = list(quotations._runs(iter([batch, batch.slice(0, 0)])))
    assert len(made) == 2 and [len(b) for b in made] == [4, 1]
    assert [k for b in made for k in b.column(0).to_pylist()] == [0, 1, 2, 3, 4] and made[0].column(1).to_pylist()[1:] == [0, 0, 7]
