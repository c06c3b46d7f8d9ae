"""Graphs in Turtle and RDF/XML as triples, a file a row: nodes are IRIs, ``_:`` labels, or literals as N-Triples write them.

Blank nodes are named by their file, so that those of different files stay apart; a graph that is written takes many files,
so its blank nodes are written as IRIs below GENID, which are read as blank nodes again. A file that breaks off or is no graph
gives the triples before its error; a row of its own tells of it in ``problem``. Files are independent tasks.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
XML = "{http://www.w3.org/XML/1998/namespace}"
#: What stands for a blank node outside its file: the graph that was written, and the node's label.
GENID = "https://brindle.invalid/.well-known/genid/"
#: Triples of a batch; subjects of a file that is written, since a task that reads a file holds it.
BATCH, SUBJECTS = 20_000, 10_000
SHAPE = "s string, p string, o string, file string, problem string"

_TOKENS = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
    |<(?P<iri>[^<>"{}|^`\\\x00-\x20]*(?:\\u[0-9A-Fa-f]{4}[^<>"{}|^`\\\x00-\x20]*)*)>
    |(?P<text>\"{3}(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"{3}|'{3}(?:(?:'|'')?(?:[^'\\]|\\.))*'{3}|\"(?:[^\"\\\n\r]|\\.)*\"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@prefix\b|@base\b|\b(?:PREFIX|BASE|prefix|base)\b(?=\s))
    |@(?P<lang>[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<typed>\^\^)
    |(?P<blank>_:[\w.-]*[\w-])
    |(?P<number>[+-]?(?:\d+\.?\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[^\W\d_][\w.-]*)?:(?:[\w:%-]|\\[_~.!$&'()*+,;=/?\#@%-]|\.(?=[\w:%\\.-]))*)
    |(?P<word>[A-Za-z]+)
    |(?P<sign>[.;,\[\]()])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class Malformed(ValueError):
    """What stands where no such thing can."""


def _plain(raw: str) -> str:
    """A string without its escapes."""
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), raw, flags=re.DOTALL)


def literal(value: str, lang: str | None = None, kind: str | None = None) -> str:
    """A literal as N-Triples write it."""
    quoted = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f'"{quoted}"' + (f"@{lang.lower()}" if lang else f"^^<{kind}>" if kind and kind != XSD + "string" else "")


class Turtle:
    """Triples of a Turtle text, read token by token."""

    def __init__(self, text: str, scope: str, base: str = ""):
        self.text, self.scope, self.base = text, scope, base
        self.prefixes: dict[str, str] = {}
        self.blanks = 0
        self.tokens = self._tokens()
        self.found: list[tuple[str, str, str]] = []
        self._next()

    def _tokens(self) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(self.text):
            m = _TOKENS.match(self.text, at)
            if not m:
                raise Malformed(f"line {self.text.count(chr(10), 0, at) + 1}: {self.text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup != "space":
                yield m.lastgroup, m[m.lastgroup]
        yield "end", ""

    def _next(self) -> tuple[str, str]:
        now = getattr(self, "ahead", None)
        self.ahead = next(self.tokens, ("end", ""))
        return now

    def _take(self, sign: str) -> None:
        if self._next() != ("sign", sign):
            raise Malformed(f"{sign!r} is missing")

    def triples(self) -> Iterator[tuple[str, str, str]]:
        while self.ahead[0] != "end":
            if self.ahead[0] == "directive":
                self._directive()
            else:
                bracketed = self.ahead == ("sign", "[")
                subject = self._node()
                if not (bracketed and self.ahead == ("sign", ".")):
                    self._about(subject, ".")
                self._take(".")
            yield from self.found
            self.found = []

    def _directive(self) -> None:
        word = self._next()[1]
        if word.lower().endswith("prefix"):
            name, target = self._next(), self._next()
            if name[0] != "name" or not name[1].endswith(":") or target[0] != "iri":
                raise Malformed("a prefix without a name or an IRI")
            self.prefixes[name[1][:-1]] = urljoin(self.base, target[1]) if self.base else target[1]
        else:
            self.base = urljoin(self.base, self._next()[1])
        if word.startswith("@"):
            self._take(".")

    def _blank(self, label: str = "") -> str:
        self.blanks += not label
        return f"_:{self.scope}{label and 'n' + label}" if label else f"_:{self.scope}g{self.blanks}"

    def _iri(self, raw: str) -> str:
        found = urljoin(self.base, _plain(raw)) if self.base else _plain(raw)
        return "_:b" + found[len(GENID) :].replace("/", "n", 1) if found.startswith(GENID) else found

    def _named(self, name: str) -> str:
        prefix, _, local = name.partition(":")
        if prefix not in self.prefixes:
            raise Malformed(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def _node(self) -> str:
        kind, raw = self._next()
        if kind == "iri":
            return self._iri(raw)
        if kind == "name":
            return self._named(raw)
        if kind == "blank":
            return self._blank(raw[2:])
        if kind == "text":
            return self._literal(raw)
        if kind == "number":
            return literal(raw, kind=XSD + ("double" if "e" in raw.lower() else "decimal" if "." in raw else "integer"))
        if (kind, raw) in (("word", "true"), ("word", "false")):
            return literal(raw, kind=XSD + "boolean")
        if raw == "[":
            own = self._blank()
            self._about(own, "]")
            self._take("]")
            return own
        if raw == "(":
            return self._list()
        raise Malformed(f"{raw or 'the end'!r} is no node")

    def _literal(self, raw: str) -> str:
        value = _plain(raw[3:-3] if raw[:3] in ('"""', "'''") and len(raw) >= 6 else raw[1:-1])
        if self.ahead[0] == "lang":
            return literal(value, lang=self._next()[1])
        if self.ahead[0] == "typed":
            self._next()
            return literal(value, kind=self._node())
        return literal(value)

    def _list(self) -> str:
        items = []
        while self.ahead != ("sign", ")"):
            items.append(self._node())
        self._next()
        head = RDF + "nil"
        for item in reversed(items):
            own = self._blank()
            self.found += [(own, RDF + "first", item), (own, RDF + "rest", head)]
            head = own
        return head

    def _about(self, subject: str, end: str) -> None:
        """Predicates and objects up to a closing sign, which is left."""
        while self.ahead != ("sign", end):
            kind, raw = self.ahead
            predicate = RDF + "type" if (kind, raw) == ("word", "a") and self._next() else self._node()
            while True:
                self.found.append((subject, predicate, self._node()))
                if self.ahead != ("sign", ","):
                    break
                self._next()
            while self.ahead == ("sign", ";"):
                self._next()


def rdf_xml(content: bytes, scope: str) -> Iterator[tuple[str, str, str]]:
    """Triples of an RDF/XML text; of an element nothing is kept once it has ended below the root."""
    blanks = 0

    def fresh(label: str | None = None) -> str:
        nonlocal blanks
        blanks += label is None
        return f"_:{scope}n{label}" if label is not None else f"_:{scope}g{blanks}"

    name = lambda tag: tag[1:].replace("}", "", 1) if tag[0] == "{" else tag
    q = lambda x: f"{{{RDF}}}{x}"

    def node(e: ElementTree.Element, base: str, lang: str | None) -> tuple[str, list]:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        about, own_id = e.get(q("about")), e.get(q("ID"))
        subject = urljoin(base, about) if about is not None else f"{base}#{own_id}" if own_id else fresh(e.get(q("nodeID")))
        out = [] if e.tag == q("Description") else [(subject, RDF + "type", name(e.tag))]
        out += [(subject, name(k), literal(v, lang)) for k, v in e.attrib.items() if not k.startswith((f"{{{RDF}}}", XML))]
        count = 0
        for child in e:
            predicate = name(child.tag)
            if child.tag == q("li"):
                count += 1
                predicate = f"{RDF}_{count}"
            value, more = _value(child, base, lang)
            out += [(subject, predicate, value), *more]
        return subject, out

    def _value(e: ElementTree.Element, base: str, lang: str | None) -> tuple[str, list]:
        lang, base = e.get(XML + "lang", lang), e.get(XML + "base", base)
        how = e.get(q("parseType"))
        if e.get(q("resource")) is not None:
            return urljoin(base, e.get(q("resource"))), []
        if e.get(q("nodeID")) is not None:
            return fresh(e.get(q("nodeID"))), []
        if how == "Literal":
            return literal((e.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in e), kind=RDF + "XMLLiteral"), []
        if how == "Resource":
            inner = ElementTree.Element(q("Description"))
            inner.extend(list(e))
            return node(inner, base, lang)
        if how == "Collection":
            head, out = RDF + "nil", []
            for child in reversed(list(e)):
                item, more = node(child, base, lang)
                own = fresh()
                out += [*more, (own, RDF + "first", item), (own, RDF + "rest", head)]
                head = own
            return head, out
        if len(e):
            return node(e[0], base, lang)
        others = {k: v for k, v in e.attrib.items() if not k.startswith((f"{{{RDF}}}", XML))}
        if others:
            own = fresh()
            return own, [(own, name(k), literal(v, lang)) for k, v in others.items()]
        return literal(e.text or "", None if e.get(q("datatype")) else lang, e.get(q("datatype"))), []

    depth, base, lang, root = 0, "", None, None
    for event, e in ElementTree.iterparse(io.BytesIO(content), events=("start", "end")):
        if event == "start":
            depth += 1
            if depth == 1:
                root, base, lang = e, e.get(XML + "base", ""), e.get(XML + "lang")
            continue
        depth -= 1
        if depth == 1 and root.tag == q("RDF"):
            yield from node(e, base, lang)[1]
            root.clear()
        elif depth == 0 and e.tag != q("RDF"):
            yield from node(e, base, lang)[1]


def graph_files(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, file, problem) of the graph files of a path: RDF/XML by its first sign, all others Turtle."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, file in enumerate(batch.column(0).to_pylist()):
                content = batch.column(1)[k].as_py()
                rows: list[tuple] = []
                scope = "b" + hashlib.md5(file.encode()).hexdigest()[:16]
                try:
                    text = content.lstrip(b"\xef\xbb\xbf \t\r\n")
                    is_xml = text.startswith((b"<?xml", b"<rdf:", b"<!DOCTYPE", b"<RDF"))
                    for triple in rdf_xml(text, scope) if is_xml else Turtle(text.decode("utf-8"), scope).triples():
                        rows.append((*triple, file, None))
                        if len(rows) >= BATCH:
                            yield _batch(rows)
                            rows = []
                except (Malformed, UnicodeDecodeError, ElementTree.ParseError) as e:
                    rows.append((None, None, None, file, str(e)))
                yield _batch(rows)

    return files.mapInArrow(read, SHAPE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["s", "p", "o", "file", "problem"])


def write_turtle(triples: DataFrame, path: str) -> None:
    """Triples as Turtle, a subject a statement, predicates and objects in order; a subject's triples are one row.

    Rows are dealt over files, so a blank node's label, which holds within its file, would part it from what leads to it. Files
    are as large however many triples there are, in number they grow.
    """
    genid = F.lit(f"<{GENID}{uuid.uuid4().hex}/")
    node = lambda c: F.when(c.startswith('"'), c).when(c.startswith("_:"), F.concat(genid, F.substring(c, 3, 2**31 - 1), F.lit(">"))).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    verb = F.when(F.col("p") == RDF + "type", F.lit("a")).otherwise(node(F.col("p")))
    objects = triples.groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_set(node(F.col("o")))), ", ").alias("o"))
    said = objects.groupBy("s").agg(F.array_sort(F.collect_list(F.concat(verb, F.lit(" "), F.col("o")))).alias("said"))
    said.select(F.concat(node(F.col("s")), F.lit(" "), F.array_join("said", " ;\n    "), F.lit(" .\n"))).write.mode("overwrite").option("maxRecordsPerFile", SUBJECTS).text(path)
