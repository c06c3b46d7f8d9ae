"""Records and tables: merging, identity by many keys, contracts, desired states, graph rewriting and closure rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.graph import closure, components
from brindle.sources.shared import written


def merged(rows: DataFrame, key: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """One record a key of (key, position, ...): each scalar's first filled value in order, lists as their union.

    ``missing`` names the scalars that no record has, which are looked at anew after merging.
    """
    first = [F.min_by(c, F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) != "", F.col("position"))).alias(c) for c in scalars]
    union = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]
    found = rows.groupBy(key).agg(*first, *union)
    return found.withColumn("missing", F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in scalars])), ","))


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """The ids ``x``, ``x-2``, ``x-3`` of repeated names."""
    k = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn(name, F.when(k == 1, F.col(key[-1])).otherwise(F.concat_ws("-", F.col(key[-1]), k.cast("string"))))


def stub_targets(stubs: DataFrame, resources: DataFrame) -> DataFrame:
    """(stub, target) of the resource that a stub's most specific key names; keys that several resources have don't count.

    stubs and resources: (stub or resource, key, place), place 0 being the most specific kind of key.
    """
    single = resources.groupBy("key").agg(F.count_distinct("resource").alias("n"), F.min("resource").alias("target")).where("n = 1")
    met = stubs.join(single, "key")
    return met.groupBy("stub").agg(F.min(F.struct("place", "target")).alias("x")).select("stub", "x.target")


def redirected(triples: DataFrame, targets: DataFrame) -> DataFrame:
    """Triples with each stub's target in its place, on both sides, each once."""
    s, o = targets.select(F.col("stub").alias("s"), F.col("target").alias("_s")), targets.select(F.col("stub").alias("o"), F.col("target").alias("_o"))
    found = triples.join(s, "s", "left").join(o, "o", "left")
    return found.select(F.coalesce("_s", "s").alias("s"), "p", F.coalesce("_o", "o").alias("o")).distinct()


def bag_difference(expected: DataFrame, given: DataFrame) -> DataFrame:
    """Rows with how often they are missing, or too many; equal numbers don't show. One aggregation, not two passes."""
    columns = expected.columns
    both = expected.withColumn("_n", F.lit(1)).unionByName(given.withColumn("_n", F.lit(-1)))
    found = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n != 0")
    return found.select(*columns, F.when(F.col("_n") > 0, "missing").otherwise("surplus").alias("side"), F.abs("_n").alias("n"))


def entailed(triples: DataFrame) -> DataFrame:
    """Triples with those that subclasses, subproperties, equivalents, inverses, domains and ranges entail.

    Closures of the schema come first, so that data are joined with them once: properties, then inverses, then types.
    """
    of = lambda p: triples.where(F.col("p") == p).select("s", "o")
    both = lambda p: of(p).unionByName(of(p).select(F.col("o").alias("s"), F.col("s").alias("o")))
    classes = closure(of("subClassOf").unionByName(both("equivalentClass")))
    properties = closure(of("subPropertyOf").unionByName(both("equivalentProperty")))
    schema = ["subClassOf", "subPropertyOf", "equivalentClass", "equivalentProperty", "inverseOf", "domain", "range"]
    data = triples.where(~F.col("p").isin(*schema)).distinct()
    wider = lambda rows: rows.unionByName(rows.join(properties.select(F.col("s").alias("p"), F.col("o").alias("_p")), "p").select("s", F.col("_p").alias("p"), "o")).distinct()
    inverse = both("inverseOf").select(F.col("s").alias("p"), F.col("o").alias("_p"))
    stated = wider(data)
    stated = wider(stated.unionByName(stated.join(inverse, "p").select(F.col("o").alias("s"), F.col("_p").alias("p"), F.col("s").alias("o")))).distinct()
    typed = lambda rule, end: stated.join(of(rule).select(F.col("s").alias("p"), F.col("o").alias("_c")), "p").select(F.col(end).alias("s"), F.lit("type").alias("p"), F.col("_c").alias("o"))
    types = stated.where("p = 'type'").unionByName(typed("domain", "s")).unionByName(typed("range", "o")).distinct()
    above = types.join(classes.select(F.col("s").alias("o"), F.col("o").alias("_c")), "o").select("s", "p", F.col("_c").alias("o"))
    return stated.unionByName(types).unionByName(above).distinct()


def graph_violations(triples: DataFrame) -> DataFrame:
    """(s, rule) of nodes against a graph's own schema: relations that it doesn't have, ends outside domain and
    range by the closure of classes, and subjects without a type."""
    of = lambda p: triples.where(F.col("p") == p).select("s", "o")
    classes = closure(of("subClassOf"))
    types = of("type")
    wide = types.unionByName(types.join(classes.select(F.col("s").alias("o"), F.col("o").alias("_c")), "o").select("s", F.col("_c").alias("o"))).distinct()
    schema = ["subClassOf", "domain", "range", "type"]
    data = triples.where(~F.col("p").isin(*schema))
    known = of("domain").select(F.col("s").alias("p")).unionByName(of("range").select(F.col("s").alias("p"))).distinct()
    unknown = data.join(known, "p", "left_anti").select("s", F.concat(F.lit("unknown relation "), "p").alias("rule"))

    def outside(rule: str, end: str) -> DataFrame:
        wanted = data.join(of(rule).select(F.col("s").alias("p"), F.col("o").alias("_c")), "p").select("s", "p", F.col(end).alias("_e"), "_c")
        return wanted.join(wide.select(F.col("s").alias("_e"), F.col("o").alias("_c")), ["_e", "_c"], "left_anti").select("s", F.concat(F.lit(f"{rule} of "), "p").alias("rule"))

    untyped = data.join(types.select("s"), "s", "left_anti").select("s", F.lit("no type").alias("rule"))
    return unknown.unionByName(outside("domain", "s")).unionByName(outside("range", "o")).unionByName(untyped).distinct()


def nested(entities: DataFrame, mentions: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row an entity with its mentions and mappings as sorted lists; each list is aggregated by itself."""
    held = mentions.groupBy("e").agg(F.array_sort(F.collect_list(F.struct("start", "surface"))).alias("mentions"))
    terms = mappings.groupBy("e").agg(F.array_sort(F.collect_list(F.struct("tier", "term"))).alias("mappings"))
    return entities.join(held, "e", "left").join(terms, "e", "left")


def observed(triples: DataFrame, checks: DataFrame) -> DataFrame:
    """A graph with a node of its own for every check (run, subject, signal), which is never changed afterwards."""
    node = F.concat_ws("/", F.lit("check"), "run", "subject")
    rows = checks.select(node.alias("s"), F.explode(F.array(F.struct(F.lit("of").alias("p"), F.col("subject").alias("o")), F.struct(F.lit("signal").alias("p"), F.col("signal").alias("o")), F.struct(F.lit("run").alias("p"), F.col("run").alias("o")))).alias("x"))
    return triples.unionByName(rows.select("s", "x.p", "x.o").join(triples.select("s").distinct(), "s", "left_anti")).distinct()


def resource_status(signals: DataFrame) -> DataFrame:
    """(subject, status) of signals (subject, kind, age): archived, deprecated, declared inactive and unavailable come
    before ages: active to 365 days, stale to 1,095, else inactive; without any date it is unknown."""
    has = lambda kind: F.bool_or(F.col("kind") == kind)
    found = signals.groupBy("subject").agg(*[has(k).alias(k) for k in ("archived", "deprecated", "inactive", "unavailable")], F.min(F.when(F.col("kind") == "dated", F.col("age"))).alias("age"))
    status = F.when(F.col("archived"), "archived").when(F.col("deprecated"), "deprecated").when(F.col("inactive"), "inactive").when(F.col("unavailable"), "unavailable").when(F.col("age") <= 365, "active").when(F.col("age") <= 1095, "stale").when(F.col("age").isNotNull(), "inactive").otherwise("unknown")
    return found.select("subject", status.alias("status"))


def wave_measures(variables: DataFrame) -> DataFrame:
    """(variable, measure): components over pairs of one paper where a name without its wave is among the other's
    wordings, unless derivation or resolved variable differ.

    variables: (variable, paper, stripped, wordings, derivation, resolved).
    """
    key = ["paper", "k", "d"]
    rest = [F.col("derivation").alias("d"), F.col("resolved").alias("r")]
    left = variables.select("variable", "paper", F.col("stripped").alias("k"), *rest)
    right = variables.select("variable", "paper", F.explode("wordings").alias("k"), *rest)
    # All of one key and resolved variable link alike: classes meet, and two variables or more that meet are one measure.
    classes = lambda side, x: side.where("paper is not null and k is not null").groupBy(*key, "r").agg(F.min("variable").alias(f"{x}_first"), F.max("variable").alias(f"{x}_last")).select(*[F.col(c).alias(f"{x}_{c}") for c in [*key, "r"]], f"{x}_first", f"{x}_last")
    a, b = classes(left, "a"), classes(right, "b")
    same = (F.col("a_paper") == F.col("b_paper")) & (F.col("a_k") == F.col("b_k")) & F.col("a_d").eqNullSafe(F.col("b_d"))
    met = a.join(b, same & F.col("a_r").eqNullSafe(F.col("b_r")))
    met = met.unionByName(a.where("a_r is null").join(b.where("b_r is not null"), same)).unionByName(a.where("a_r is not null").join(b.where("b_r is null"), same))
    met = written(met.where("least(a_first, b_first) < greatest(a_last, b_last)"), "classes")

    def members(side: DataFrame, x: str) -> DataFrame:
        hubs = met.select(*[F.col(f"{x}_{c}") for c in [*key, "r", "first"]]).distinct()
        of = (F.col("paper") == F.col(f"{x}_paper")) & (F.col("k") == F.col(f"{x}_k")) & F.col("d").eqNullSafe(F.col(f"{x}_d")) & F.col("r").eqNullSafe(F.col(f"{x}_r"))
        return side.join(hubs, of).select(F.col("variable").alias("s"), F.col(f"{x}_first").alias("o"))

    pairs = met.select(F.col("a_first").alias("s"), F.col("b_first").alias("o")).unionByName(members(left, "a")).unionByName(members(right, "b")).where("s != o")
    found = components(pairs)
    return variables.select("variable").join(found.select(F.col("v").alias("variable"), "component"), "variable", "left").select("variable", F.coalesce("component", "variable").alias("measure"))


def identifiers(rows: DataFrame, taxa: DataFrame) -> DataFrame:
    """(row, node, covered) of rows by any identifier of a taxonomy's nodes (node, ids, species); an unknown species of
    either leaves the coverage open."""
    index = taxa.select("node", F.explode(F.array_distinct("ids")).alias("id"), F.col("species").alias("own"))
    found = rows.join(index, "id", "left")
    covered = F.when(F.col("node").isNotNull() & F.col("own").isNotNull() & F.col("species").isNotNull(), F.array_contains("own", F.col("species")))
    return found.select("row", "node", covered.alias("covered"))


def containing(points: DataFrame, parts: DataFrame) -> DataFrame:
    """(point, part) of the part of a document that a point (point, doc, at) is in; parts (part, doc, start, stop).

    Both are dealt out by stretches of a document, so a point meets only parts of its own stretch, and of parts that nest
    the one that starts last is taken.
    """
    width = 4096
    near = parts.select("part", "doc", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))).alias("cell")).where("stop > start")
    met = points.withColumn("cell", F.floor(F.col("at") / width)).join(near, ["doc", "cell"]).where("at >= start and at < stop")
    best = met.groupBy("point").agg(F.max(F.struct("start", "part")).alias("x"))
    return points.select("point").join(best, "point", "left").select("point", F.col("x.part").alias("part"))


def unfilled(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows that the target lacks, to be appended."""
    return source.join(target.select(key), key, "left_anti")


def greedy(spans: DataFrame) -> DataFrame:
    """Of each document's spans, by start and the longest first, those that don't overlap one taken before."""
    order = F.array_sort(F.collect_list(F.struct("start", (-F.col("stop")).alias("far"), "span")))
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda a, x: F.struct(F.when(x["start"] >= a["end"], -x["far"]).otherwise(a["end"]).alias("end"), F.when(x["start"] >= a["end"], F.array_append(a["kept"], x["span"])).otherwise(a["kept"]).alias("kept"))
    return spans.groupBy("doc").agg(F.aggregate(order, start, step)["kept"].alias("kept")).select("doc", F.explode("kept").alias("span"))


def chain_heads(edges: DataFrame) -> DataFrame:
    """(old, head): the end of the chain of supersessions (new, old) from each row that was superseded."""
    paths = closure(edges.select(F.col("old").alias("s"), F.col("new").alias("o")))
    return paths.join(edges.select(F.col("old").alias("o")), "o", "left_anti").select(F.col("s").alias("old"), F.col("o").alias("head"))


def desired_actions(wanted: DataFrame, actual: DataFrame) -> DataFrame:
    """K7: (name, action, place) that turn an actual state (name, value) into a wanted one, creations first, removals last."""
    both = wanted.select("name", F.col("value").alias("want")).join(actual.select("name", F.col("value").alias("have")), "name", "full")
    action = F.when(F.col("have").isNull(), "create").when(F.col("want").isNull(), "delete").when(~F.col("want").eqNullSafe(F.col("have")), "update")
    place = F.when(action == "create", 0).when(action == "update", 1).otherwise(2)
    return both.select("name", action.alias("action"), place.alias("place")).where("action is not null")


def overridden(rows: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields with an override's filled value in place, and which fields were changed."""
    other = overrides.select(key, *[F.nullif(F.trim(F.col(f)), F.lit("")).alias(f"_{f}") for f in fields])
    found = rows.join(other, key, "left")
    changed = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_{f}").isNotNull() & ~F.col(f"_{f}").eqNullSafe(F.col(f)), F.lit(f)) for f in fields])), ",")
    return found.withColumn("changed", changed).select(*[c for c in rows.columns if c not in fields], *[F.coalesce(f"_{f}", f).alias(f) for f in fields], "changed")


def contract(cells: DataFrame, columns: DataFrame, vocabularies: DataFrame) -> DataFrame:
    """V1: (row, column, problem) of cells (row, column, value) against a contract (column, required, kind, vocabulary, many).

    ``NA`` stands where a value does not apply, which required cells may not; multi-valued cells are split at bars.
    """
    held = cells.join(columns, "column", "left")
    value = F.coalesce("value", F.lit(""))
    kinds = F.when(F.col("kind") == "integer", value.rlike(r"^[+-]?\d+$")).when(F.col("kind") == "float", value.try_cast("double").isNotNull()).when(F.col("kind") == "boolean", value.isin("true", "false")).when(F.col("kind") == "date", F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).isNotNull()).otherwise(True)
    basic = F.when(F.col("kind").isNull(), "unknown column").when(F.col("required") & (value == ""), "empty").when(F.col("required") & (value == "NA"), "NA in a required cell").when((value != "") & (value != "NA") & ~F.col("many") & ~kinds, "wrong type")
    first = held.select("row", "column", basic.alias("problem")).where("problem is not null")
    parts = held.where("vocabulary is not null").where(~value.isin("", "NA")).select("row", "column", "vocabulary", F.explode(F.when(F.col("many"), F.split(value, r"(?<!\\)\|")).otherwise(F.array(value))).alias("term"))
    odd = parts.join(vocabularies, ["vocabulary", "term"], "left_anti").select("row", "column", F.concat(F.lit("not in vocabulary: "), "term").alias("problem"))
    return first.unionByName(odd)


def aligned(rows: DataFrame, groups: list[list[str]]) -> DataFrame:
    """V1: rows whose parallel multi-valued cells don't have the same number of values."""
    n = lambda c: F.when(F.coalesce(c, F.lit("")).isin("", "NA"), 0).otherwise(F.size(F.split(F.col(c), r"(?<!\\)\|")))
    bad = F.array_compact(F.array(*[F.when(F.greatest(*[n(c) for c in g]) != F.least(*[n(c) for c in g]), F.lit("+".join(g))) for g in groups if len(g) > 1]))
    return rows.select("row", F.explode(bad).alias("columns"))


def conforming(record: Column, names: list[str], enums: dict[str, list[str]]) -> Column:
    """(kept, notes) of a map: unknown fields and values outside their enumeration go, each with a note; a record
    without a name is null."""
    allowed = lambda k, v: k.isin(*names) & ~_outside(k, v, enums)
    kept = F.map_filter(record, allowed)
    entries = F.map_entries(record)
    notes = F.transform(F.filter(entries, lambda x: ~allowed(x["key"], x["value"])), lambda x: F.concat(F.when(x["key"].isin(*names), "bad value of ").otherwise("unknown field "), x["key"]))
    return F.when(F.coalesce(F.trim(F.try_element_at(record, F.lit("name"))), F.lit("")) != "", F.struct(kept.alias("kept"), F.array_sort(notes).alias("notes")))


def _outside(key: Column, value: Column, enums: dict[str, list[str]]) -> Column:
    found = F.lit(False)
    for name, values in enums.items():
        found |= (key == name) & ~F.coalesce(value.isin(*values), F.lit(False))
    return found


def source_grounded(values: Column, text: Column) -> Column:
    """(kept, removed) of values by whether a text holds them, whatever their case."""
    there = lambda v: F.lower(text).contains(F.lower(v))
    return F.struct(F.filter(values, there).alias("kept"), F.filter(values, lambda v: ~there(v)).alias("removed"))


def stale(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state) of files against their recorded hashes: same, changed, missing, or not recorded."""
    both = manifest.select("path", F.col("sha").alias("was")).join(current.select("path", F.col("sha").alias("now")), "path", "full")
    return both.select("path", F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "unrecorded").when(F.col("was") == F.col("now"), "same").otherwise("changed").alias("state"))


def best_copies(files: DataFrame) -> DataFrame:
    """Of files with one hash the copy of the lowest rank, then the shortest, then the first path."""
    return files.groupBy("sha").agg(F.min(F.struct("rank", F.length("path").alias("n"), "path")).alias("x"), F.count(F.lit(1)).alias("copies")).select("sha", "x.path", "copies")


def text_rank(rows: DataFrame, query: str, text: str, limit: int) -> DataFrame:
    """Rows that hold all words of a query, by how much of the text these are; the list has ``limit`` rows.

    Words are stemmed by cutting plural endings; the rank is their share of the text's words, which is not that of any
    full-text engine.
    """
    stems = lambda c: F.transform(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.regexp_replace(w, "(?:es|s)$", ""))
    wanted = F.array_distinct(stems(F.lit(query)))
    held = rows.withColumn("_w", stems(F.col(text)))
    met = held.where(F.size(F.array_except(wanted, "_w")) == 0)
    hits = F.size(F.filter("_w", lambda w: F.array_contains(wanted, w)))
    return met.withColumn("rank", F.round(hits / F.size("_w"), 6)).drop("_w").orderBy(F.desc("rank"), *rows.columns[:1]).limit(limit)


def additive_top(rows: DataFrame, regions: list[str], limit: int) -> DataFrame:
    """O3: rows (ordinal, primary, regions, a, b, c) by 8 for a primary, 3 for each wanted region up to three, 2, 1 and 1."""
    score = F.when(F.col("primary"), 8).otherwise(0) + 3 * F.least(F.lit(3), F.size(F.array_intersect("regions", F.array(*[F.lit(r) for r in regions])))) + F.when(F.col("a"), 2).otherwise(0) + F.when(F.col("b"), 1).otherwise(0) + F.when(F.col("c"), 1).otherwise(0)
    return rows.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "ordinal").limit(limit)
