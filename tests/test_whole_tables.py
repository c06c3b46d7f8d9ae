"""Queries over whole tables, on small tables with what their narrower forms leave out."""

from brindle.functions import quotes
from brindle.plans import registry


def save(spark, where, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{where}/{name}.parquet")
    return str(where)


def run(spark, name, where):
    return sorted(tuple(r) for r in registry.queries()[name](spark, where).collect())


def test_components_of_all_lines(spark, tmp_path):
    lines = [(s, p) for s, p in [(1, 10), (1, 11), (2, 11), (3, 12), (4, 13), (4, 12)]]
    where = save(spark, tmp_path, lineitem=([(s, p, "F", 1.0) for s, p in lines], "l_suppkey long, l_partkey long, l_linestatus string, l_quantity double"))
    assert run(spark, "connected_components_whole", where) == [(-4, -4), (-3, -4), (-2, -2), (-1, -2), (10, -2), (11, -2), (12, -4), (13, -4)]


def test_violations_of_all_parts_and_suppliers(spark, tmp_path):
    where = save(
        spark, tmp_path,
        lineitem=([(1, 1, 7, 5), (1, 2, 8, 6), (1, 3, 9, 6)], "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long"), part=([(7,), (8,)], "p_partkey long"),
        supplier=([(5,)], "s_suppkey long"), orders=([(1,), (2,)], "o_orderkey long"),
    )
    assert run(spark, "referential_violations_whole", where) == [("order_without_lines", 2, 1), ("unknown_part", 9, 1), ("unknown_supplier", 6, 2)]


def test_sets_of_all_orders(spark, tmp_path):
    where = save(
        spark, tmp_path,
        lineitem=([(1, 7), (2, 7), (2, 8)], "l_orderkey long, l_partkey long"), part=([(7, "a", 1), (8, "b", 1)], "p_partkey long, p_type string, p_size int"),
        orders=([(1, "HIGH", "F"), (2, "LOW", "O")], "o_orderkey long, o_orderpriority string, o_orderstatus string"),
    )
    assert run(spark, "jaccard_sets_whole", where) == [("HIGH", "LOW", 1, 0.5)]


def test_members_of_equal_texts(spark, tmp_path):
    where = save(spark, tmp_path, documents=([(3, "a"), (1, "a"), (2, "b"), (4, "a")], "doc_id long, text string"))
    assert run(spark, "near_duplicate_members", where) == [(1, 1, "representative"), (2, 2, "representative"), (3, 1, "identical text"), (4, 1, "identical text")]


def test_quotes_by_any_run(spark, tmp_path):
    quote = "one two three four five six seven eight nine ten eleven 5"
    docs = [(1, f"x {quote}!"), (2, f"{quote}7"), (3, quote.upper()), (4, quote.replace("one", "other")), (5, "one two three four five six and no more"), (6, "the dose is 15 mg"), (7, "dose 5 mg, 日本語"), (8, None), (9, "")]
    items = [(1, quote), (2, "5 mg"), (3, "日本"), (4, "日本語"), (5, None), (6, "")]
    where = save(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    got = run(spark, "quote_location_whole", where)
    every = sorted((d, i, *quotes.locate(q, t)) for d, t in docs for i, q in items if quotes.locate(q, t)[0] != "absent")
    assert got == every
    assert [r[:3] for r in got] == [(1, 1, "exact"), (2, 1, "paraphrase"), (3, 1, "normalized"), (4, 1, "paraphrase"), (7, 2, "exact"), (7, 4, "exact")]
