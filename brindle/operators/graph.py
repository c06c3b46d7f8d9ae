"""Triple tables and pattern queries: basic patterns, optional and minus, closure, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.sources.shared import unsent, written


def triples(*parts: DataFrame) -> DataFrame:
    """Union of (s, p, o) string tables, each triple once."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def triple(rows: DataFrame, s: Column, p: str, o: Column) -> DataFrame:
    return rows.select(s.cast("string").alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"))


def pattern(graph: DataFrame, predicate: str, s: str, o: str) -> DataFrame:
    """Bindings of one triple pattern with a fixed predicate."""
    return graph.where(F.col("p") == predicate).select(F.col("s").alias(s), F.col("o").alias(o))


def _cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    return written(df, "graph")


def closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """Distinct (s, o) reachable by one edge or more, by deltas: a round joins only the paths that the last one found.

    New paths are put before and behind all that are known, so paths double each round and those of a cycle come round
    once; what is known is taken off by an anti-join, and a round's result is written.
    """
    have = new = _cut(edges.select("s", "o").where("s is not null and o is not null").distinct())
    for _ in range(most):
        behind = new.alias("a").join(have.alias("b"), F.col("a.o") == F.col("b.s")).select("a.s", "b.o")
        ahead = have.alias("a").join(new.alias("b"), F.col("a.o") == F.col("b.s")).select("a.s", "b.o")
        new = _cut(behind.unionByName(ahead).distinct().join(have, ["s", "o"], "left_anti"))
        if new.isEmpty():
            return have
        have = _cut(have.unionByName(new))
    raise RuntimeError("the closure did not settle")


def stretches(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(v, head, place) of nodes behind the head of an unbranched stretch, and (s, o) of heads whose stretches reach others; None if none does.

    An edge that is its source's only one and its target's only one lies on a stretch; every other leads from the last
    node of a stretch to the head of one, so what is reachable follows from places and from the closure over heads.
    Nodes are told their heads by doubling, a row a node and round. What isn't told is a ring of such edges, whose nodes
    are stretches of one. Nodes that are not in the first table are heads; edges from a node to itself are left out.
    """
    each = edges.select("s", "o").where("s != o").distinct()
    many = lambda end: each.groupBy(end).agg(F.count(F.lit(1)).alias(f"_{end}"))
    each = _cut(each.join(many("s"), "s").join(many("o"), "o").select("s", "o", ((F.col("_s") == 1) & (F.col("_o") == 1)).alias("plain")))
    rows = _cut(each.where("plain").select(F.col("o").alias("v"), F.col("s").alias("head"), F.lit(1).cast("long").alias("place"), F.lit(True).alias("open")))
    before, left = None, rows.count()
    # A round tells some nodes of each stretch that has any left, so if it tells none, only rings are left.
    while left and left != before:
        ahead = rows.select(F.col("v").alias("head"), F.col("head").alias("_head"), F.col("place").alias("_place"), F.col("open").alias("_open"))
        moved = rows.where("open").join(ahead, "head", "left").select("v", F.coalesce("_head", "head").alias("head"), (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place"), F.coalesce("_open", F.lit(False)).alias("open"))
        rows = _cut(rows.where("not open").unionByName(moved))
        before, left = left, rows.where("open").count()
    told = rows.where("not open").select("v", "head", "place")
    between = each.where("not plain").select("s", "o")
    if left:
        between = between.unionByName(each.where("plain").join(rows.where("open").select(F.col("v").alias("o")), "o", "left_semi").select("s", "o"))
    if between.isEmpty():
        return told, None
    own = told.select(F.col("v").alias("s"), "head")
    return told, closure(between.join(own, "s", "left").select(F.coalesce("head", "s").alias("s"), "o"))


#: Predicates that say what others mean.
SCHEMA = ["subClassOf", "subPropertyOf", "equivalentClass", "equivalentProperty", "inverseOf", "domain", "range"]
#: Types of properties, and the predicate of chains: (property, propertyChainAxiom, "p q").
TRANSITIVE, SYMMETRIC, FUNCTIONAL, CHAIN, SAME = "TransitiveProperty", "SymmetricProperty", "FunctionalProperty", "propertyChainAxiom", "sameAs"


def same_nodes(triples: DataFrame) -> DataFrame:
    """(v, component): nodes that sameAs makes equal, by the smallest of them."""
    return components(triples.where(F.col("p") == SAME).select("s", "o").where("s != o"))


def represented(triples: DataFrame, classes: DataFrame) -> DataFrame:
    """Triples with every node as the first of its class of equal nodes."""
    for end in ("s", "o"):
        triples = triples.join(classes.select(F.col("v").alias(end), F.col("component").alias("_first")), end, "left").withColumn(end, F.coalesce("_first", end)).drop("_first")
    return triples.select("s", "p", "o").distinct()


def saturated(triples: DataFrame, most: int = 64) -> DataFrame:
    """Triples (s, p, o) with all that their schema entails, to a fix-point over deltas.

    Rules: subclasses and subproperties with their equivalents, inverses, domains and ranges, symmetric and transitive
    properties, chains of two, functional properties and sameAs. Equal nodes are one node, the first by name, while rules
    run, so that n of them don't make n * n triples; sameAs triples lead from each to it, and the result names it in
    their place. A round applies the rules to what the last one added; the schema's own closures come first.
    """
    classes = _cut(same_nodes(triples))
    base = _cut(represented(triples.where(F.col("p") != SAME), classes))
    merged = classes
    for _ in range(most):
        found, equal = _rules(base, most)
        if equal.isEmpty():
            links = merged.where("v != component").select(F.col("v").alias("s"), F.lit(SAME).alias("p"), F.col("component").alias("o"))
            return found.unionByName(links).distinct()
        # A functional property made nodes equal: classes grow, and rules run on the nodes that are left.
        more = components(equal)
        merged = _cut(merged.join(more.select(F.col("v").alias("component"), F.col("component").alias("_up")), "component", "left").select("v", F.coalesce("_up", "component").alias("component")).unionByName(more.join(merged.select("v"), "v", "left_anti").select("v", "component")))
        base = _cut(represented(base, more))
    raise RuntimeError("equal nodes did not settle")


def _rules(base: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(saturated triples, (s, o) of nodes that functional properties make equal) over nodes that are no equals yet."""
    of = lambda p: base.where(F.col("p") == p).select("s", "o")
    both = lambda p: of(p).unionByName(of(p).select(F.col("o").alias("s"), F.col("s").alias("o")))
    above = closure(of("subClassOf").unionByName(both("equivalentClass")))
    wider = closure(of("subPropertyOf").unionByName(both("equivalentProperty")))
    typed = lambda kind: base.where((F.col("p") == "type") & (F.col("o") == kind)).select(F.col("s").alias("p"))
    turned = both("inverseOf").unionByName(typed(SYMMETRIC).select(F.col("p").alias("s"), F.col("p").alias("o"))).distinct()
    steps = of(CHAIN).select(F.col("s").alias("_p"), F.split("o", " ")[0].alias("_a"), F.split("o", " ")[1].alias("_b"))
    steps = _cut(steps.unionByName(typed(TRANSITIVE).select(F.col("p").alias("_p"), F.col("p").alias("_a"), F.col("p").alias("_b"))).distinct())
    have = new = _cut(base.where(~F.col("p").isin(*SCHEMA, CHAIN)).distinct())
    for _ in range(most):
        rename = lambda pairs: new.join(pairs.select(F.col("s").alias("p"), F.col("o").alias("_p")), "p")  # noqa: B023, E731
        got = rename(wider).select("s", F.col("_p").alias("p"), "o")
        got = got.unionByName(rename(turned).select(F.col("o").alias("s"), F.col("_p").alias("p"), F.col("s").alias("o")))
        for rule, end in (("domain", "s"), ("range", "o")):
            got = got.unionByName(rename(of(rule)).select(F.col(end).alias("s"), F.lit("type").alias("p"), F.col("_p").alias("o")))
        got = got.unionByName(new.where("p = 'type'").join(above.select(F.col("s").alias("o"), F.col("o").alias("_c")), "o").select("s", "p", F.col("_c").alias("o")))
        first = lambda rows: rows.select(F.col("s").alias("_s"), F.col("p").alias("_a"), F.col("o").alias("_m"))
        then = lambda rows: rows.select(F.col("s").alias("_m"), F.col("p").alias("_b"), F.col("o").alias("_o"))
        for a, b in ((new, have), (have, new)):
            pairs = first(a).join(steps, "_a").join(then(b), ["_m", "_b"])
            got = got.unionByName(pairs.select(F.col("_s").alias("s"), F.col("_p").alias("p"), F.col("_o").alias("o")))
        new = _cut(got.distinct().join(have, ["s", "p", "o"], "left_anti"))
        if new.isEmpty():
            break
        have = _cut(have.unionByName(new))
    else:
        raise RuntimeError("rules did not settle")
    held = have.join(typed(FUNCTIONAL), "p", "left_semi").groupBy("s", "p").agg(F.min("o").alias("first"), F.count_distinct("o").alias("n")).where("n > 1")
    equal = have.join(held.select("s", "p", "first"), ["s", "p"]).where("o != first").select(F.col("o").alias("s"), F.col("first").alias("o")).distinct()
    schema = base.where(F.col("p").isin(*SCHEMA, CHAIN))
    return have.unionByName(schema).distinct(), _cut(equal)


def components(edges: DataFrame, most: int = 64) -> DataFrame:
    """(v, component): the smallest vertex that each vertex of (s, o) edges reaches in either direction.

    Each round takes the smallest label among neighbours, then that label's own label, so long paths are halved.
    """
    both = _cut(edges.select("s", "o").unionByName(edges.select(F.col("o").alias("s"), F.col("s").alias("o"))).distinct())
    label = _cut(both.groupBy(F.col("s").alias("v")).agg(F.least(F.min("o"), F.col("s")).alias("component")))
    for _ in range(most):
        near = both.join(unsent(label), F.col("o") == F.col("v")).groupBy("s").agg(F.min("component").alias("near"))
        lower = label.join(unsent(near), F.col("v") == F.col("s")).select("v", F.least("component", "near").alias("c"), F.col("component").alias("was"))
        own = label.select(F.col("v").alias("c"), F.col("component").alias("up"))
        then = _cut(lower.join(unsent(own), "c", "left").select("v", F.least("c", F.coalesce("up", "c")).alias("component"), "was"))
        if then.where("component != was").isEmpty():
            return then.select("v", "component")
        label = then.select("v", "component")
    raise RuntimeError("components did not settle")
