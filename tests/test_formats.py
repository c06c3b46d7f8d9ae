"""Files and small formats."""

from pyspark.sql import functions as F

from brindle.functions import parse
from brindle.operators import corrections
from brindle.sources import files


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"title": "x", "n": 1}')
    (tmp_path / "b.json").write_text("[not json")
    (tmp_path / "own_out.json").write_text('{"title": "y", "n": 2}')
    found, skipped = files.json_documents(spark, str(tmp_path), "title string, n int", ["own_out.json"])
    assert [(r.title, r.n) for r in found.collect()] == [("x", 1)]
    assert [r.path.rsplit("/", 1)[-1] for r in skipped.collect()] == ["b.json"]


def test_delimited(spark, tmp_path):
    (tmp_path / "log.tsv").write_text("iteration\ttimestamp_utc\tstatus\tmetric_value\n1\t2026-04-14T10:30:00Z\tOK\t0.5\n2\tbad\tfail\tnan\n3\n")
    got = files.results_log(spark, str(tmp_path / "log.tsv")).orderBy("iteration").collect()
    assert [(r.iteration, r.status, r.metric, r.ts is None) for r in got] == [(1, "ok", 0.5, False), (2, "fail", None, True), (3, "", None, True)]
    files.write_csv(spark.createDataFrame([("a", "b,c")], "x string, y string"), str(tmp_path / "out"), ["y", "x"])
    assert [tuple(r) for r in files.csv_table(spark, str(tmp_path / "out"), ["y", "x"]).collect()] == [("b,c", "a")]


def test_n_triples(spark, tmp_path):
    (tmp_path / "g.nt").write_text('# c\n<u:a> <u:p> <u:b> .\n<u:a> <u:q> "x \\" y"^^<u:t> .\n_:n <u:p> <u:a> .\nbroken\n')
    got = files.n_triples(spark, str(tmp_path / "g.nt"))
    assert {tuple(r) for r in got.collect()} == {("u:a", "u:p", "u:b"), ("u:a", "u:q", '"x \\" y"^^<u:t>'), ("_:n", "u:p", "u:a")}
    files.write_n_triples(got, str(tmp_path / "again"))
    assert {tuple(r) for r in files.n_triples(spark, str(tmp_path / "again")).collect()} == {tuple(r) for r in got.collect()}


def test_parsers(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert [value(parse.duration_seconds(F.lit(x))) for x in ("1h 30m", "90", "2d", "x", "")] == [5400, 90, 172800, None, None]
    assert [value(parse.walltime_minutes(F.lit(x))) for x in ("90", "10:30", "01:30:00", "1-02", "unlimited")] == [90, 10.5, 90, 1560, None]
    assert [value(parse.size_bytes(F.lit(x))) for x in ("2g", "3", "1.5k", "x")] == [2 << 30, 3 << 20, 1536, None]
    assert value(parse.doi(F.lit("see https://doi.org/10.1234/AB.c)."))) == "10.1234/ab.c" and value(parse.year(F.lit("in 2021, 1800"))) == 2021
    assert value(parse.percent_holds(F.lit(1), F.lit(3), F.lit(33.3), F.lit(1))) and not value(parse.percent_holds(F.lit(4), F.lit(3), F.lit(133.3), F.lit(1)))


def test_corrections(spark):
    rows = spark.createDataFrame([("a", None, ""), ("b", "a", "k")], "id string, over string, note string")
    assert [r.id for r in corrections.current(rows, "id", "over").collect()] == ["b"]
    names = spark.createDataFrame([("a", "z")], "old string, new string")
    assert {tuple(r) for r in corrections.relabelled(rows, "id", names).collect()} == {("z", None, ""), ("b", "a", "k")}
    confirmed = spark.createDataFrame([("a", "new"), ("b", "other")], "id string, note string")
    assert {(r.id, r.note) for r in corrections.filled(rows, confirmed, "id", ["note"]).collect()} == {("a", "new"), ("b", "k")}
