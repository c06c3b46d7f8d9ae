"""Graphs in Turtle and RDF/XML against their triples."""

import pytest
from pyspark.sql import functions as F

from brindle.sources import files, turtle
from brindle.sources.turtle import RDF, XSD, Turtle, literal, rdf_xml

RECORD = """
@prefix ner: <https://example.org/ner/> .
PREFIX ex: <https://example.org/kb/x-3/>
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@base <https://example.org/base/> .

#### A publication ####
ex:publication a ner:Publication ;
    ner:doi   "10.1038/s1-2" ;   # a comment; with "signs" .
    ner:title "Learning by \\"optimization\\" of\\u0020neural \\U0001F9E0 maps"@en-GB , \"\"\"two
"lines\"\"\"@de ;
    ner:hasVersion ex:v1.0, <rel#a> ; .
ex:v1.0 ner:size 12, -3.5, 1e6, true ; ner:when "2026-01-05"^^<http://www.w3.org/2001/XMLSchema#date> .
_:run ner:used [ a ner:Agent ; rdfs:label 'it''s' ] .
[ ner:lonely () ] .
ex:l ner:items ( ex:a "b" ( 1 ) [] ) .
""".replace("'it''s'", "'it\\'s'")


def test_turtle_tokens():
    got = list(Turtle(RECORD, "b").triples())
    ner, kb = "https://example.org/ner/", "https://example.org/kb/x-3/"
    wanted = {
        (kb + "publication", RDF + "type", ner + "Publication"), (kb + "publication", ner + "doi", '"10.1038/s1-2"'), (kb + "publication", ner + "title", '"Learning by \\"optimization\\" of neural 🧠 maps"@en-gb'),
        (kb + "publication", ner + "title", '"two\\n\\"lines"@de'), (kb + "publication", ner + "hasVersion", kb + "v1.0"), (kb + "publication", ner + "hasVersion", "https://example.org/base/rel#a"),
        (kb + "v1.0", ner + "size", f'"12"^^<{XSD}integer>'), (kb + "v1.0", ner + "size", f'"-3.5"^^<{XSD}decimal>'), (kb + "v1.0", ner + "size", f'"1e6"^^<{XSD}double>'), (kb + "v1.0", ner + "size", f'"true"^^<{XSD}boolean>'), (kb + "v1.0", ner + "when", f'"2026-01-05"^^<{XSD}date>'),
        ("_:bnrun", ner + "used", "_:bg1"), ("_:bg1", RDF + "type", ner + "Agent"), ("_:bg1", "http://www.w3.org/2000/01/rdf-schema#label", '"it\'s"'), ("_:bg2", ner + "lonely", RDF + "nil"),
    }
    assert wanted <= set(got)
    rest = set(got) - wanted
    nodes = dict((s, o) for s, p, o in rest if p == RDF + "rest")
    items = dict((s, o) for s, p, o in rest if p == RDF + "first")
    at, found = next(o for s, p, o in rest if p == ner + "items"), []
    while at != RDF + "nil":
        found.append(items[at])
        at = nodes[at]
    assert found[:2] == [kb + "a", '"b"'] and items[found[2]] == f'"1"^^<{XSD}integer>' and found[3].startswith("_:") and len(found) == 4


@pytest.mark.parametrize("broken", ["x:a x:b x:c .", "<a> <b> .", "<a> <b> <c>", "<a> <b> [ <c> <d> .", '<a> <b> "x\ny" .', "<a> <b> ( <c> ."])
def test_broken_turtle(broken):
    with pytest.raises(turtle.Malformed):
        list(Turtle(broken, "b").triples())


def test_rdf_xml():
    text = f"""<?xml version="1.0"?><rdf:RDF xmlns:rdf="{RDF}" xmlns:x="http://x/" xml:base="http://b/">
    <x:Thing rdf:about="a" x:note="n"><x:label xml:lang="en">A &amp; B</x:label><x:size rdf:datatype="{XSD}integer">3</x:size><x:to rdf:resource="#c"/>
      <x:part><rdf:Description rdf:nodeID="q"><x:deep>1</x:deep></rdf:Description></x:part><x:res rdf:parseType="Resource"><x:k>v</x:k></x:res></x:Thing>
    <rdf:Description rdf:about="http://o/"><x:all rdf:parseType="Collection"><rdf:Description rdf:about="http://i/1"/></x:all></rdf:Description></rdf:RDF>"""
    got = set(rdf_xml(text.encode(), "b"))
    assert {("http://b/a", RDF + "type", "http://x/Thing"), ("http://b/a", "http://x/note", '"n"'), ("http://b/a", "http://x/label", '"A & B"@en'), ("http://b/a", "http://x/size", f'"3"^^<{XSD}integer>'), ("http://b/a", "http://x/to", "http://b/#c"), ("http://b/a", "http://x/part", "_:bnq"), ("_:bnq", "http://x/deep", '"1"')} <= got
    assert ("http://b/a", "http://x/res", "_:bg1") in got and ("_:bg1", "http://x/k", '"v"') in got and len(got) == 12


def test_files_and_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ttl").write_text(RECORD)
    (tmp_path / "in" / "b.ttl").write_text("<http://s> <http://p> <http://o> .\n<broken")
    (tmp_path / "in" / "c.rdf").write_text(f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:x="http://x/"><x:T rdf:about="http://t"/></rdf:RDF>')
    (tmp_path / "in" / "d.ttl").write_text("")
    read = turtle.graph_files(spark, f"{tmp_path}/in").collect()
    assert [r.file.rsplit("/", 1)[1] for r in read if r.problem] == ["b.ttl"] and ("http://t", RDF + "type", "http://x/T") in {r[:3] for r in read}
    triples = spark.createDataFrame([tuple(r[:3]) for r in read if not r.problem], "s string, p string, o string").distinct()
    files.write_n_triples(triples, f"{tmp_path}/nt")
    turtle.write_turtle(triples, f"{tmp_path}/ttl")
    lines = {tuple(r) for r in files.n_triples(spark, f"{tmp_path}/nt/*.txt").collect()}
    again = [tuple(r[:3]) for r in turtle.graph_files(spark, f"{tmp_path}/ttl/*.txt").collect()]
    plain = lambda rows: sorted(t for t in rows if "_:" not in t[0] + t[2])
    assert plain(again) == plain(lines) and len(again) == len(lines) == triples.count()
    assert literal('a"\\\n', "EN") == '"a\\"\\\\\\n"@en'


def test_blank_nodes_over_files(spark, tmp_path):
    """A blank node keeps what leads to it when a graph is written in several files."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(f"http://s/{k}", "http://p", f"_:n{k}") for k in range(40)] + [(f"_:n{k}", "http://q", f'"{k}"') for k in range(40)]
        for name in ("a", "b"):
            turtle.write_turtle(spark.createDataFrame(rows, "s string, p string, o string"), f"{tmp_path}/{name}")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = turtle.graph_files(spark, f"{tmp_path}/[ab]/*.txt").collect()
    assert len({r.file for r in read}) > 2 and not any(r.problem for r in read)
    held = {r.s: r.o for r in read if r.p == "http://q"}
    assert len(held) == 80 and sorted(held[r.o] for r in read if r.p == "http://p") == sorted(f'"{k}"' for k in range(40) for _ in "ab")


def test_written_graphs_take_files_of_one_size(spark, tmp_path, monkeypatch):
    """F8: a task that reads a file holds it, so a larger graph takes more files, not larger ones."""
    monkeypatch.setattr(turtle, "SUBJECTS", 5)
    triples = spark.range(100).selectExpr("concat('http://x/s', id % 50) AS s", "concat('http://x/p', id % 3) AS p", "concat('\"', id, '\"') AS o")
    turtle.write_turtle(triples.coalesce(1), f"{tmp_path}/ttl")
    found = turtle.graph_files(spark, f"{tmp_path}/ttl/*.txt")
    assert sorted(tuple(r) for r in found.select("s", "p", "o").collect()) == sorted(tuple(r) for r in triples.collect())
    assert max(r.n for r in found.groupBy("file").agg(F.count_distinct("s").alias("n")).collect()) <= 5
