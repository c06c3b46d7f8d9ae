"""Many rows that share a key: work grows with rows, not with pairs of them. What takes longer is cancelled, and fails."""

import random
from threading import Timer

from pyspark.sql import functions as F

from brindle.graph import entities
from brindle.operators import claims, context, mentions, records, runs
from brindle.plans import registry


def within(spark, seconds, made):
    """The rows of ``made()``, whose jobs are cancelled after some seconds."""
    timer = Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return made().collect()
    finally:
        timer.cancel()


def test_variable_uses_of_one_name(spark):
    """40,000 uses of a name that 40,000 variables have."""
    uses = spark.range(40_000).select(F.col("id").alias("use"), F.lit("w").alias("name"), F.concat(F.lit("r"), F.col("id") % 3).alias("role"))
    variables = spark.range(40_000).select(F.col("id").alias("variable"), F.lit("w").alias("wording"), F.lit("m").alias("measure"), F.when(F.col("id") == 7, "r1").otherwise("r2").alias("role"))
    found = within(spark, 40, lambda: runs.roles_of_variables(uses, variables).groupBy("variable").count())
    assert {r["variable"]: r["count"] for r in found} == {7: 13_333, None: 26_667}


def test_opposed_claims_are_not_shuffled(spark):
    """rows are distinct without a shuffle of them all; a claim over two pairs with equal keys meets another once."""
    make = lambda rows, shape: spark.createDataFrame(rows, shape)
    tables = {
        "entity": make([(1, "a"), (2, "b"), (3, "a"), (4, "b")], "e long, key string"),
        "causal": make([(10, 1, 2, 7, 100), (10, 3, 4, 7, 100), (11, 1, 2, 8, 101), (11, 3, 4, 8, 101), (12, 1, 2, 7, 102), (13, 1, 2, 9, 103)], "rel long, cause long, effect long, pub long, v long"),
        "causal_version": make([(100, 10, True), (101, 11, False), (102, 12, False), (103, 13, True)], "v long, rel long, negated boolean").selectExpr("*", "false AS hypothetical", "'x' AS polarity", "'y' AS evidence"),
    }
    found = entities.opposed(tables)
    assert sorted(map(tuple, found.collect())) == [(10, 11, 7, 8, "a", "b"), (13, 11, 9, 8, "a", "b"), (13, 12, 9, 7, "a", "b")]
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_values_of_one_long_study(spark):
    """3,000 quotes of one study, whose text is made uniform once and searched once for each other quote."""
    numbers = spark.range(3000)
    values = numbers.selectExpr("id", "1L AS study", "concat(id % 40, ' mg') AS value")
    quotes = numbers.where("id % 5 > 0").selectExpr("id", "CASE WHEN id % 5 = 1 THEN 2L ELSE 1L END AS study", "concat('gave ', id % 40, CASE WHEN id % 5 = 2 THEN ' g' ELSE ' mg' END) AS quote")
    texts = numbers.groupBy().agg(F.array_join(F.collect_list(F.expr("concat('gave ', id % 40, ' mg to item', id)")), ". ").alias("text")).selectExpr("1L AS study", "text")
    found = within(spark, 30, lambda: claims.value_statuses(values, quotes, texts).groupBy("status", "reason").count())
    assert {tuple(r) for r in found} == {("ungrounded", "no quote", 600), ("ungrounded", "no quote stands", 1200), ("grounded", "", 1200)}


def test_measures_of_one_name(spark):
    """F8: 30,000 variables of one paper and name; others are told apart by their derivation and resolved variable."""
    many = spark.range(30_000).selectExpr("id AS variable", "1 AS paper", "'n' AS stripped", "array('n') AS wordings", "CAST(NULL AS string) AS derivation", "CASE WHEN id % 3 > 0 THEN concat('r', id % 3) END AS resolved")
    odd = [(40_000, 2, "a", ["b"], None, "x"), (40_001, 2, "b", ["c"], None, "y"), (40_002, 2, "b", ["a"], None, "x"), (40_003, 3, "s", ["s"], "d", None), (40_004, 3, "s", ["s"], None, None)]
    rows = many.unionByName(spark.createDataFrame(odd, "variable long, paper int, stripped string, wordings array<string>, derivation string, resolved string"))
    found = within(spark, 60, lambda: records.wave_measures(rows).groupBy("measure").count())
    assert {tuple(r) for r in found} == {(0, 30_000), (40_000, 2), (40_001, 1), (40_003, 1), (40_004, 1)}


def test_first_reviews_at_one_place(spark):
    """which of two reviews at one place counts does not depend on the order in which they come."""
    rows = [("J1", "A", "pass", 0.5, None, 1), ("J1", "a", "fail", 0.4, "b", 1), ("J1", "a", "fail", 0.4, "a", 1)]
    for order in (rows, rows[::-1]):
        found = mentions.first_reviews(spark.createDataFrame(order, "judge string, id string, verdict string, confidence double, reason string, place long").coalesce(1))
        assert [(r.verdict, r.reason) for r in found.collect()] == [("fail", "a")]


def _chained(spark, following, members):
    one = lambda text: spark.sql(text)
    return {
        "entity": one("SELECT 1L AS e, 'c' AS key UNION ALL SELECT 2L, 'd'"),
        "causal": members.select("rel").distinct().selectExpr("rel", "1L AS cause", "2L AS effect"),
        "chain": members.select("chain").distinct().selectExpr("chain", "'n' AS label"),
        "chain_relation": members,
        "next_relation": following,
    }


def test_places_in_a_long_chain(spark):
    """5,000 relations one after the other make a row each, not 12 million paths."""
    rels = spark.range(5000)
    tables = _chained(spark, rels.where("id < 4999").select(F.col("id").alias("rel"), (F.col("id") + 1).alias("following")), rels.selectExpr("id % 2 AS chain", "id AS rel"))
    found = within(spark, 60, lambda: entities.chains(tables))
    assert {(r.chain, r.rel): r.position for r in found} == {(k % 2, k): k // 2 for k in range(5000)}


def test_places_in_any_graph(spark):
    """forks, joins, rings and relations outside the chain, against a walk from each relation."""
    rng = random.Random(4)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(34)] + [(k, k + 1) for k in range(50, 60)] + [(70, 71), (71, 72), (72, 70), (80, 81), (81, 80), (81, 82), (82, 83), (90, 90), (91, None)]
    rows = [(c, r) for c in range(3) for r in range(95) if rng.random() < 0.6]
    reach = {}
    for start in range(95):
        seen, todo = set(), [start]
        while todo:
            at = todo.pop()
            for a, b in pairs:
                if a == at and b is not None and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[start] = seen
    tables = _chained(spark, spark.createDataFrame(pairs, "rel long, following long"), spark.createDataFrame(rows + rows[:9], "chain long, rel long"))
    found = entities.chains(tables).collect()
    assert sorted((r.chain, r.rel, r.position) for r in found) == sorted((c, r, sum(s != r and r in reach[s] for d, s in set(rows) if d == c)) for c, r in rows)


def test_candidates_are_scored_once(spark):
    """every vote of a decision reads the scored candidates, none makes them again."""
    found = spark.range(300).selectExpr("id % 50 AS mention", "concat('v', id) AS name", "'t' AS table", "'d' AS domain", "0.6 + id / 1000 AS score", "double(0.9) AS coverage")
    decided = context.decided(found)
    assert "Range" not in decided._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.mention, r.status, r.variable) for r in decided.collect()} == {(m, "variable", f"v{m + 250}") for m in range(50)}


def test_lines_at_one_place_count_in_the_order_of_their_file(spark, tmp_path):
    """of lines of one order, number and part the first of the table counts, whatever its verdict."""
    rows = [(1, 1, 7, "N", 0.08, 0.01), (1, 1, 7, "R", 0.04, 0.07), (2, 1, 7, "R", 0.04, 0.07), (2, 1, 7, "N", 0.08, 0.01)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_returnflag string, l_discount double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r.id: (r.remarks, r.score) for r in registry.queries()["combined_verdicts"](spark, str(tmp_path)).collect()}
    assert found == {"item1": ("J1:flag", 0.0333), "item2": ("J1:fail — because 7", 0.0)}
    assert {r.id: r.reason for r in registry.queries()["verdict_operations"](spark, str(tmp_path)).collect()} == {"item1": "J1:flag", "item2": "J1:fail — because 7"}


def test_papers_that_share_entities_are_counted_in_cells(spark, monkeypatch):
    """cells of few papers, and tasks of few pairs, count what all pairs do; equal rows of a source are one."""
    monkeypatch.setattr(entities, "CELL", 3)
    monkeypatch.setattr(entities, "COUNTED", 50)
    rng = random.Random(6)
    held = sorted({(e, p) for e in range(40) for p in rng.sample(range(30), rng.randint(1, 12))})
    dois = [(p, f"10.5/{p}" if p % 3 else None) for p in range(28)] + [(4, "10.5/4"), (4, "10.5/x")]
    tables = {"entity_source": spark.createDataFrame([*held, *held[:20], (1, None), (None, 1), (None, 2)], "e long, pub long"), "source": spark.createDataFrame(dois, "pub long, doi string")}
    of = lambda p: {d for q, d in dois if q == p} or {None}
    wanted = []
    for p in range(30):
        for q in range(30):
            shared = len({e for e, x in held if x == p} & {e for e, x in held if x == q})
            wanted += [(p, q, d, o, shared) for d in of(p) for o in of(q) if p != q and shared]
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in entities.related_papers(tables).collect())
    assert {r.doi for r in entities.related_papers(tables, "10.5/x").collect()} == {"10.5/x"}
