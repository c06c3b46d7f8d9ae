"""Operators on literals: ties, nulls, empty frames."""

from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.operators import entities, graph, ordered, spans, verdicts


def test_canonical_surface_ties(spark):
    rows = spark.createDataFrame([("k", "ab"), ("k", "abc"), ("k", "abd"), (None, "x")], "k string, s string")
    assert {tuple(r) for r in entities.canonical_surface(rows, ["k"], "s").collect()} == {("k", "abc", 1), (None, "x", 1)}


def test_top_with_other_without_rest(spark):
    counts = spark.createDataFrame([("a", 2), ("b", 1)], "label string, n long")
    assert [tuple(r) for r in entities.top_with_other(counts, "label", "n", 5).collect()] == [("a", 2), ("b", 1)]


def test_verdicts_without_weight(spark):
    rows = spark.createDataFrame([("i", "pass", 0.0, 1.0, None)], "id string, verdict string, weight double, confidence double, critical boolean")
    assert tuple(verdicts.weighted_scores(rows, ["id"]).first()) == ("i", None, 1, False)


def test_trailing_failures(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 4, True), ("b", 1, False), ("c", 1, True)], "k string, i int, bad boolean")
    assert {tuple(r) for r in ordered.trailing_failures(rows, ["k"], F.col("i"), F.col("bad")).collect()} == {("a", 2), ("b", 0), ("c", 1)}


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "s string, o string")
    assert graph.closure(edges).count() == 9
    assert graph.closure(edges.limit(0)).count() == 0


def test_shingles(spark):
    df = spark.createDataFrame([("A b, c d e f",), ("a b",), ("",)], "t string").select(tx.tokens(F.col("t")).alias("w")).select(tx.shingles(F.col("w"), 5).alias("s"))
    assert [r.s for r in df.collect()] == [["a b c d e", "b c d e f"], [], []]


def test_components_of_paths_and_loops(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 50), (60, 61), (61, 60)], "s long, o long")
    got = {tuple(r) for r in graph.components(edges).collect()}
    assert got == {(k, 0) for k in range(21)} | {(50, 50), (60, 60), (61, 60)}
    assert graph.components(edges.limit(0)).count() == 0


def test_span_functions():
    text = "One went, e.g. Two came. Three left et al. Four stayed! five"
    assert [text[a:b] for a, b in spans.sentences(text)] == ["One went, e.g. Two came.", "Three left et al. Four stayed! five"]
    assert spans.chunks("", 5) == [] and spans.chunks("abc", 5) == [(0, 3)]
    long = "Aa bb. Cc dd. Ee ff. Gg hh."
    assert [long[a:b] for a, b in spans.chunks(long, 14)] == ["Aa bb. Cc dd.", "Cc dd. Ee ff.", "Ee ff. Gg hh."]
    assert spans.repair("a cat, a cat", "cat", 6) == (9, "span_repaired") and spans.repair("x", "cat", 0) == (None, "not_found") and spans.repair("cat", "cat", 0) == (0, "exact")
    assert spans.mask("abcdef", [(0, 2), (1, 5)]) == "a[__]f"
