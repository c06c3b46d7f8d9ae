"""License scans by ordered signature rules, in DataFrame functions alone.

A text is brought to its words, joined by single spaces, once; every rule is a regular expression over that form, written
by hand in :mod:`brindle.llm.license_rules`. A rule's expression runs only over texts that hold its keyword, a literal
part of every match, and rules with one keyword are asked for it together. Of overlapping detections the one of higher
priority stays where it contains the other, the longer one at equal priority, the earlier rule at equal length.

Defined cases: null and empty texts have no words and no detections; repeated rows are scanned alike; ties between rules
over the same words go to the earlier rule; a text is scanned whole, whatever its length: detections are spans of words,
found in one pass over the words, and each is held against those that begin at most MOST_WORDS words before it; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.license_rules import SIGNATURES

#: What separates words once A-Z is lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases of the base scan and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: How sure a detection of each priority is.
WEIGHTS = {6: 0.99, 5: 0.95, 4: 0.9, 3: 0.8, 2: 0.7, 1: 0.5}
#: More words than any rule's match has.
MOST_WORDS = 64
#: What marks the first and the last character of a match; no word has them.
_OPEN, _SHUT = "\x01", "\x02"
_SPANS = "array<struct<s:int,e:int,label:string,p:int,w:double,i:int>>"


class Rule(NamedTuple):
    label: str
    expression: str
    keyword: str
    need: str
    priority: int
    weight: float


def rules() -> list[Rule]:
    """All rules in order."""
    return [Rule(label, f"(?<= )(?:{text})(?= )", key, "", p, WEIGHTS[p]) for label, text, key, p in SIGNATURES]


#: Keywords of which one stands in every detection: those that hold no other one.
TRIGGERS = sorted({r.keyword for r in rules() if not any(o.keyword in r.keyword for o in rules() if o.keyword != r.keyword)})


def words_form(text: Column) -> Column:
    """The text's words, each between single spaces; one space if there is none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.concat(F.lit(" "), F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, lower), GAPS, " "), F.lit(" "))


def _hits(form: Column) -> Column:
    """Array of (m, i): for every rule that matches, the form with its matches marked, and the rule's number."""
    by_key: dict[str, list[Column]] = {}
    for i, r in enumerate(rules()):
        marked = F.struct(F.regexp_replace(form, F.lit(r.expression), F.lit(f"{_OPEN}$0{_SHUT}")).alias("m"), F.lit(i).alias("i"))
        by_key.setdefault(r.keyword, []).append(F.when(form.contains(r.need) & form.rlike(r.expression), marked))
    none = F.array().cast("array<struct<m:string,i:int>>")
    return F.concat(*[F.when(form.contains(key), F.array_compact(F.array(*found))).otherwise(none) for key, found in by_key.items()])


def _detections(hits: Column) -> Column:
    """Array of (s, e, label, p, w, i): spans of words, from words whose marks open and shut."""
    own = rules()
    labels, priorities, weights = (F.array(*[F.lit(r[k]) for r in own]) for k in (0, 4, 5))

    def places(words: Column, there) -> Column:
        return F.filter(F.transform(words, lambda w, k: F.when(there(w), k)), lambda k: k.isNotNull())

    def spans(hit: Column) -> Column:
        words = F.split(F.trim(hit["m"]), " ")
        found = F.zip_with(places(words, lambda w: w.startswith(_OPEN)), places(words, lambda w: w.endswith(_SHUT)), lambda s, e: F.struct(s.alias("s"), (e + 1).alias("e")))
        i = hit["i"]
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.get(labels, i).alias("label"), F.get(priorities, i).alias("p"), F.get(weights, i).alias("w"), i.alias("i")))

    return F.flatten(F.transform(hits, spans)).cast(_SPANS)


def _ordered(found: Column) -> Column:
    """Detections by start, longest first, and of each span the one of highest rank, first."""
    return F.transform(F.array_sort(F.transform(found, lambda d: F.struct(d["s"].alias("s"), (-d["e"]).alias("e"), (-d["p"]).alias("p"), d["i"].alias("i"), d["label"].alias("label"), d["w"].alias("w")))), lambda d: F.struct(d["s"].alias("s"), (-d["e"]).alias("e"), d["label"].alias("label"), (-d["p"]).alias("p"), d["w"].alias("w"), d["i"].alias("i")))


def _first_of_span(ordered: Column) -> Column:
    return F.filter(ordered, lambda d, k: ~F.coalesce((F.get(ordered, k - 1)["s"] == d["s"]) & (F.get(ordered, k - 1)["e"] == d["e"]), F.lit(False)))


def _suppressed(spans: Column) -> Column:
    """Detections, one of each span and in order, that no other one of higher rank contains.

    What contains one begins no more than MOST_WORDS words before it, and stands at most MOST_WORDS^2 places before.
    """
    reach = MOST_WORDS * MOST_WORDS

    def beaten(d: Column, k: Column) -> Column:
        before = F.slice(spans, F.greatest(k - reach, F.lit(0)) + 1, F.least(k, F.lit(reach)))
        return F.exists(before, lambda o: (o["e"] >= d["e"]) & (o["p"] >= d["p"]))

    def behind(d: Column, k: Column) -> Column:
        return F.filter(F.array(d), lambda x: ~beaten(x, k))

    return F.flatten(F.transform(spans, behind))


def _word_at(form: Column, place: Column) -> Column:
    """Index of the word that follows the space at a 1-based place."""
    before = F.substring(form, F.lit(1), place)
    return (F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))) - 1).cast("long")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections), one row per row of docs.

    detections: array of (s, e, label, p, w, i), spans of words from s to before e, after suppression.
    """
    form = F.col("form")
    formed = docs.select(F.col(f"`{id_col}`").alias("id"), F.regexp_replace(words_form(F.col(f"`{text_col}`")), "^ +", " ").alias("form"))
    formed = formed.select("id", F.when(form == " ", F.lit(" ")).otherwise(F.regexp_replace(form, " +$", " ")).alias("form"))
    gate = F.lit(False)
    for word in TRIGGERS:
        gate |= form.contains(word)
    gated = formed.select("id", "form", (F.length("form") - F.length(F.replace(form, F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"), gate.alias("gate"))
    base = {}
    for k, (phrase, label) in enumerate(BASE.items()):
        sought = f" {phrase} "
        base[k] = (sought, label)
    counts = [F.when(form.contains(s), F.regexp_count(form, F.lit(f"(?={s})"))).otherwise(0).cast("long").alias(f"n{k}") for k, (s, _) in base.items()]
    firsts = [F.when(form.contains(s), _word_at(form, F.instr(form, s))).alias(f"f{k}") for k, (s, _) in base.items()]
    lasts = [F.when(form.contains(s), _word_at(form, F.length(form) - F.instr(F.reverse(form), s[::-1]) - len(s) + 2)).alias(f"l{k}") for k, (s, _) in base.items()]
    hits = gated.select("id", "n_words", *counts, *firsts, *lasts, F.when(F.col("gate"), _hits(form)).otherwise(F.array().cast("array<struct<m:string,i:int>>")).alias("hits"))
    names = ["id", "n_words", *[f"{c}{k}" for c in "nfl" for k in base]]
    none = F.array().cast(_SPANS)
    found = hits.select(*names, F.when(F.size("hits") > 0, _detections(F.col("hits"))).otherwise(none).alias("found"))
    ordered = found.select(*names, F.when(F.size("found") > 1, _ordered(F.col("found"))).otherwise(F.col("found")).alias("ordered"))
    single = ordered.select(*names, F.when(F.size("ordered") > 1, _first_of_span(F.col("ordered"))).otherwise(F.col("ordered")).alias("spans"))
    kept = single.select(*names, F.when(F.size("spans") > 1, _suppressed(F.col("spans"))).otherwise(F.col("spans")).alias("detections"))
    base_labels = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"n{k}") > 0, F.lit(label)) for k, (_, label) in base.items()])))
    own = F.array_distinct(F.transform("detections", lambda d: d["label"]))
    weights = F.transform("detections", lambda d: d["w"])
    return kept.select(
        "id", "n_words", (F.col("n0") + F.col("n1") + F.col("n2")).alias("n_base"),
        F.least("f0", "f1", "f2").alias("first_word"), F.greatest("l0", "l1", "l2").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base_labels, own)), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(weights), F.lit(0.0)), F.when(F.size(base_labels) > 0, 0.95).otherwise(0.0)).alias("score"), "detections",
    )
