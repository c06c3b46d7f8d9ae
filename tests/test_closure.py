"""Closures, entailment, renaming and ranks against brute force."""

import random

import pytest

from brindle.operators import corrections, graph
from brindle.operators.ordered import dense_ranks


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_with_cycles(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(16)] + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b"), (None, "a")]
    wanted = {e for e in edges if e[0]}
    while True:
        more = {(a, d) for a, b in wanted for c, d in wanted if b == c} - wanted
        if not more:
            break
        wanted |= more
    assert {tuple(r) for r in graph.closure(spark.createDataFrame(edges, "s string, o string")).collect()} == wanted


def brute(triples):
    """All that the rules entail, equal nodes replaced by the first of them."""
    triples = set(triples)
    while True:
        same = [(s, o) for s, p, o in triples if p == "sameAs" and s != o]
        of = lambda p: {(s, o) for s, q, o in triples if q == p}  # noqa: B023, E731
        typed = lambda kind: {s for s, p, o in triples if p == "type" and o == kind}  # noqa: B023, E731
        new = set()
        sub, props = of("subClassOf") | of("equivalentClass") | {(b, a) for a, b in of("equivalentClass")}, of("subPropertyOf") | of("equivalentProperty") | {(b, a) for a, b in of("equivalentProperty")}
        inverse = of("inverseOf") | {(b, a) for a, b in of("inverseOf")} | {(p, p) for p in typed("SymmetricProperty")}
        chains = [(s, *o.split()) for s, o in of("propertyChainAxiom")] + [(p, p, p) for p in typed("TransitiveProperty")]
        schema = {*graph.SCHEMA, "propertyChainAxiom", "sameAs"}
        for s, p, o in triples:
            if p in schema:
                continue
            new |= {(s, q, o) for a, q in props if a == p} | {(o, q, s) for a, q in inverse if a == p}
            new |= {(s, "type", c) for a, c in of("domain") if a == p} | {(o, "type", c) for a, c in of("range") if a == p}
            new |= {(s, p, c) for a, c in sub if p == "type" and a == o}
            for q, a, b in chains:
                new |= {(s, q, o2) for s2, p2, o2 in triples if p == a and p2 == b and s2 == o} if p == a else set()
            if p in typed("FunctionalProperty"):
                new |= {(max(o, o2), "sameAs", min(o, o2)) for s2, p2, o2 in triples if (s2, p2) == (s, p) and o2 != o}
        if same:
            a, b = max(same[0]), min(same[0])
            swap = lambda x: b if x == a else x  # noqa: B023, E731
            triples = {(swap(s), p, swap(o)) for s, p, o in triples if p != "sameAs"} | {(swap(s), p, swap(o)) for s, p, o in triples if p == "sameAs" and swap(s) != swap(o)}
            continue
        if new <= triples:
            return triples
        triples |= new


@pytest.mark.parametrize("seed", [3, 4])
def test_saturated_against_brute_force(spark, seed):
    rng = random.Random(seed)
    schema = [("A", "subClassOf", "B"), ("B", "subClassOf", "C"), ("C", "equivalentClass", "D"), ("D", "subClassOf", "A"), ("p", "subPropertyOf", "q"), ("q", "inverseOf", "r"), ("p", "domain", "A"), ("q", "range", "E"), ("t", "type", "TransitiveProperty"), ("y", "type", "SymmetricProperty"), ("g", "propertyChainAxiom", "p t"), ("f", "type", "FunctionalProperty")]
    data = [(f"n{rng.randrange(9)}", rng.choice("pqrtyf"), f"n{rng.randrange(9)}") for _ in range(14)] + [("n1", "sameAs", "n7"), ("n7", "sameAs", "n8"), ("n2", "type", "A")]
    got = {tuple(r) for r in graph.saturated(spark.createDataFrame(schema + data, "s string, p string, o string")).collect()}
    assert {t for t in got if t[1] != "sameAs"} == brute(schema + data)
    assert {("n7", "sameAs", "n1"), ("n8", "sameAs", "n1")} <= got | {(s, "sameAs", "n1") for s, p, o in got if p == "sameAs"}


def test_rekeyed_by_chains(spark):
    names = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("x", "z"), ("m", "n"), ("n", "m"), ("k", "m"), ("e", "e"), (None, "q"), ("w", "x")]
    names_df = spark.createDataFrame(names, "old string, new string")
    rows = spark.createDataFrame([(1, "a", "b"), (2, "x", "m"), (3, "k", None), (4, "w", "d"), (5, "e", "c")], "id long, u string, v string")
    tables, problems = corrections.rekeyed({"t": (rows, ["u", "v"])}, names_df)
    assert sorted(map(tuple, tables["t"].collect())) == [(1, "d", "d"), (2, "x", "m"), (3, "k", None), (4, "x", "d"), (5, "e", "d")]
    assert sorted(map(tuple, problems.collect())) == [("m", "cycle"), ("n", "cycle"), ("x", "clash")]
    long = spark.createDataFrame([(f"{k:03}", f"{k + 1:03}") for k in range(100)], "old string, new string")
    new, none = corrections.resolved_keys(long)
    assert {r.new for r in new.collect()} == {"100"} and new.count() == 100 and none.count() == 0


def test_set_algebra(spark):
    left = spark.createDataFrame([("k", 1), ("k", 2), ("l", 3), ("k", None)], "key string, v int")
    right = spark.createDataFrame([("k", 2), ("k", 4), ("m", 5)], "key string, v int")
    assert sorted(map(tuple, corrections.set_algebra(left, right, "key", "v").collect())) == [("k", [2], [1], [4]), ("l", [], [3], []), ("m", [], [], [5])]


def test_dense_ranks_over_ranges(spark):
    rng = random.Random(5)
    values = [rng.randrange(300) for _ in range(800)] + [None]
    got = dense_ranks(spark.createDataFrame(list(enumerate(values)), "id long, v long"), "v")
    place = {v: k for k, v in enumerate(sorted({v for v in values if v is not None}), 1)}
    assert {r.id: r.number for r in got.collect()} == {k: place.get(v) for k, v in enumerate(values)}
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
