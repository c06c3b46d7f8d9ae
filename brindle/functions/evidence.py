"""Evidence in texts: uniform forms, quantities and their equality, shares, sections, absences, percentages, titles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.uniform import canon, canon_each, normal, normal_each

# Units, their other spellings; words whose number is a label; values of absence.
UNITS = "%|‰|mg/kg|mg/dl|mmol/l|µg|μg|ug|ng|mg|kg|g|ml|µl|μl|dl|l|mmol|µmol|μmol|nmol|mol|nm|µm|μm|mm|cm|km|m|ms|msec|sec|s|min|mins|minutes?|h|hr|hrs|hours?|days?|weeks?|months?|years?|yrs?|hz|khz|mhz|db|°c|bpm|mmhg|kcal|cal|fold|x|points?|pts?|kb|mb|gb|tb"
ALIASES = {"msec": "ms", "sec": "s", "mins": "min", "minute": "min", "minutes": "min", "hr": "h", "hrs": "h", "hour": "h", "hours": "h", "day": "days", "week": "weeks", "month": "months", "year": "years", "yr": "years", "yrs": "years", "point": "points", "pt": "points", "pts": "points", "ug": "µg", "x": "fold"}
LABELS = "section|sections|table|tables|figure|figures|fig|appendix|item|items|rq|ec|ic|step|phase|version|v|pmid|pmids|level|question|q|domain|criterion|criteria|wave|arm|chapter|page|pages|ref|refs"
ABSENT = ["", "nr", "n/r", "na", "n/a", "not reported", "not stated", "none reported", "unknown", "unclear", "not applicable", "cannot tell", "not specified", "no", "-", "—", "none"]
UNGROUNDED = "NR (not source-grounded)"
_LINK = r"(?i)https?://\S+|\b10\.\d{4,9}/\S+"
_QUANTITY = rf"(?i)[<>≤≥±]?\s*(?<![\w.,])(?<![A-Za-z_]-)(?<!(?:{LABELS})\s{{0,3}}[.:#]?\s{{0,3}})[+-]?\d+(?:\.\d+)?(?!\d)(?:\s?(?:{UNITS})(?!\w))?"


def quantities(text: Column, keep_years: bool = False) -> Column:
    """F16: (op, sign, value, decimals, pct, unit) of a text's quantities; labels, parts of names, links and bare years aren't."""
    return _quantities(canon(text), keep_years)


def _quantities(spelt: Column, keep_years: bool = False) -> Column:
    """The quantities of a text in the uniform spelling."""
    found = F.regexp_extract_all(F.regexp_replace(spelt, _LINK, " "), F.lit(_QUANTITY), F.lit(0))
    number = lambda m: F.regexp_extract(m, r"(\d+(?:\.\d+)?)", 1)
    raw = lambda m: F.replace(F.lower(F.regexp_extract(m, r"\d+(?:\.\d+)?\s?(.*)$", 1)), F.lit("μ"), F.lit("µ"))
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    unit = lambda m: F.when(raw(m) == "%", "").otherwise(F.coalesce(F.try_element_at(alias, raw(m)), raw(m)))
    made = F.transform(
        found,
        lambda m: F.struct(
            F.regexp_extract(m, "^([<>≤≥±])", 1).alias("op"), F.when(m.rlike(r"^\W*-\d"), "-").otherwise("").alias("sign"), number(m).cast("double").alias("value"),
            F.length(F.regexp_extract(number(m), r"\.(\d+)$", 1)).alias("decimals"), (raw(m) == "%").alias("pct"), unit(m).alias("unit"), (number(m).rlike(r"^(19|20)\d\d$") & ~m.rlike(r"^\W*[+-]\d")).alias("year"),
        ),
    )
    kept = made if keep_years else F.filter(made, lambda q: ~q["year"] | (q["op"] != "") | q["pct"])
    return F.transform(kept, lambda q: F.struct(*[q[c].alias(c) for c in ("op", "sign", "value", "decimals", "pct", "unit")]))


def same(claimed: Column, held: Column) -> Column:
    """equal comparator, sign, value and percent, and unit where the claimed one has one."""
    return (claimed["op"] == held["op"]) & (claimed["sign"] == held["sign"]) & (claimed["pct"] == held["pct"]) & (F.abs(claimed["value"] - held["value"]) < 1e-9) & ((claimed["unit"] == "") | (claimed["unit"] == held["unit"]))


def shown(q: Column) -> Column:
    """A quantity as it is printed."""
    exact = F.when(q["decimals"] > 0, F.regexp_replace(F.format_string("%.6f", q["value"]), r"\.?0+$", "")).otherwise(q["value"].cast("long").cast("string"))
    return F.concat(q["op"], q["sign"], exact, F.when(q["pct"], "%").when(q["unit"] != "", F.concat(F.lit(" "), q["unit"])).otherwise(""))


def _let(body: Callable[[Column], Column], **named: Column) -> Column:
    """``body`` of columns that are made once, before it: expressions of Python can't stand inside another's lambda."""
    return F.transform(F.array(F.struct(*[c.alias(name) for name, c in named.items()])), body)[0]


def missing(value: Column, quote: Column) -> Column:
    """quantities of a value that a quote doesn't hold."""
    return _let(lambda r: F.filter(r["told"], lambda q: ~F.exists(r["held"], lambda x: same(q, x))), told=quantities(value), held=quantities(quote, keep_years=True))


def shares(text: Column) -> Column:
    """(n, d) of ``12 of 40``, ``12/40`` and ``12 out of 40``; years are no shares."""
    s, rx = F.regexp_replace(canon(text), _LINK, " "), r"(?i)(?<![\w.])(\d[\d,]*)\s*(?:of|out of|/)\s*(\d[\d,]*)(?![\d.])"
    part = lambda k: F.regexp_extract_all(s, F.lit(rx), F.lit(k))
    year = lambda x: F.replace(x, F.lit(","), F.lit("")).rlike(r"^(19|20)\d\d$")
    whole = lambda x: F.replace(x, F.lit(","), F.lit("")).cast("long")
    found = F.filter(F.arrays_zip(part(1).alias("n"), part(2).alias("d")), lambda p: ~year(p["n"]) & ~year(p["d"]))
    return F.transform(found, lambda p: F.struct(whole(p["n"]).alias("n"), whole(p["d"]).alias("d")))


def unpaired(text: Column, quotes: Column) -> Column:
    """shares of a text whose two numbers no single quote holds."""
    has = lambda quote, n: F.exists(_quantities(quote, keep_years=True), lambda q: ~q["pct"] & (F.floor(q["value"]) == n))
    return _let(lambda r: F.filter(r["told"], lambda p: ~F.exists(r["held"], lambda x: has(x, p["n"]) & has(x, p["d"]))), told=shares(text), held=canon_each(quotes))


_HEADING = r"(?im)^\s*(?:#+\s*)?(?:[0-9IVX]+(?:\.\d+)*\.?\s+)?(abstract|summary|introduction|background|(?:materials and |patients and |subjects and )?methods?|methodology|experimental(?: section| procedures)?|results(?: and discussion)?|findings|discussion|conclusions?|concluding remarks|limitations|references|acknowledg\w*|supplementary\b.*)\s*[:.]?\s*$"
# What headings mean, first match wins.
SECTIONS = [("abstract|summary", ["abstract"]), ("introduction|background", ["introduction"]), ("results and discussion", ["results", "discussion"]), ("method|experimental|materials", ["methods"]), ("result|finding", ["results"]), ("discussion|limitation", ["discussion"]), ("conclu", ["conclusion"]), ("reference|acknowledg|supplementary", ["back"])]


def section_names(name: Column) -> Column:
    """the sections that a heading stands for; none for an unknown one."""
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    found = F.when(F.lit(False), F.array().cast("array<string>"))
    for pattern, names in SECTIONS:
        found = found.when(n.rlike(pattern), F.array(*[F.lit(x) for x in names]))
    return found.when(n == "title", F.array(F.lit("title"))).otherwise(F.array().cast("array<string>"))


def sections(text: Column) -> Column:
    """(names, body) of a text's parts; what stands before the first heading is abstract and front."""
    heads = F.regexp_extract_all(text, F.lit(_HEADING), F.lit(1))
    bodies = F.split(text, _HEADING, -1)
    front = F.array(F.array(F.lit("abstract"), F.lit("front")))
    names = F.when(F.size(heads) > 0, F.concat(front, F.transform(heads, section_names))).otherwise(F.array(F.array().cast("array<string>")))
    return F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("names"), b.alias("body")))


def within(words: Column, text: Column) -> Column:
    """Whether tokens joined by spaces stand in a row in others."""
    return (words != "") & F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), words, F.lit(" ")))


def holds(text: Column, quote: Column) -> Column:
    """Whether a text holds a quote's words and numbers in a row, in the uniform form."""
    return within(normal(quote), normal(text))


def section_check(claimed: Column, quote: Column, text: Column) -> Column:
    """whether a quote is in the section claimed: ok, mismatch, unverifiable without such a section, skip without a claim.

    A section holds a quote if it has the quote's words and numbers in a row, in the uniform form.
    """
    wanted, parts, q = section_names(claimed), sections(text), normal(quote)
    bodies = normal_each(F.transform(parts, lambda p: p["body"]))
    rows = F.arrays_zip(parts.alias("p"), bodies.alias("b"), F.array_repeat(q, F.size(parts)).alias("q"))
    held = F.transform(rows, lambda x: F.struct(F.arrays_overlap(x["p"]["names"], wanted).alias("of"), within(x["q"], x["b"]).alias("holds")))
    any_of = lambda test: F.exists(held, test)
    return F.when(F.size(wanted) == 0, "skip").when(any_of(lambda p: p["of"] & p["holds"]), "ok").when(~any_of(lambda p: p["of"]), "unverifiable").when(any_of(lambda p: p["holds"]), "mismatch").otherwise("unverifiable")


def is_absent(value: Column) -> Column:
    """Whether a value says that nothing was reported."""
    v = F.trim(F.coalesce(value, F.lit("")))
    head = F.regexp_replace(F.lower(F.trim(F.regexp_replace(v, r"\s*[(\[].*$", ""))), r"[.;:]+$", "")
    return (v == UNGROUNDED) | head.isin(*ABSENT)


def percentages(text: Column) -> Column:
    """(n, d, percent, problem) of ``n of d (p%)``: impossible, a mismatch, or null if it adds up."""
    rx = r"(\d[\d,]*)\s*(?:of|out of|/)\s*(\d[\d,]*)(?:\s+[\w-]+){0,6}\s*\(\s*(\d+(?:\.\d+)?)\s*%\s*[);,]"
    part = lambda k: F.regexp_extract_all(text, F.lit(rx), F.lit(k))
    whole = lambda x: F.replace(x, F.lit(","), F.lit("")).cast("long")
    found = F.arrays_zip(part(1).alias("n"), part(2).alias("d"), part(3).alias("p"))

    def judged(x: Column) -> Column:
        n, d, p = whole(x["n"]), whole(x["d"]), x["p"].cast("double")
        apart = F.abs(F.try_divide(n * 100.0, d) - p)
        problem = F.when((d == 0) | (n > d), "impossible").when(apart > F.when(x["p"].contains("."), 0.06).otherwise(0.51), "mismatch")
        return F.struct(n.alias("n"), d.alias("d"), p.alias("percent"), problem.alias("problem"))

    return F.transform(found, judged)


def plain_title(title: Column) -> Column:
    """a title without tags, entities of tags, accents and signs, in lower case."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), "<[^>]+>", " ")), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"), "[^a-z0-9]+", " "))


def clean_doi(doi: Column) -> Column:
    """a bare DOI in lower case, without the forms of links and without closing signs."""
    d = F.regexp_replace(F.trim(F.coalesce(doi, F.lit(""))), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    plain = F.regexp_replace(F.lower(F.trim(d)), r"[.,;:\]}>\"']+$", "")
    return F.when(plain.endswith(")") & ~plain.contains("("), F.regexp_replace(plain, r"[).,;:]+$", "")).otherwise(plain)


def first_year(text: Column) -> Column:
    """the first year of 1900 to 2099."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"((?:19|20)\d\d)", 1).try_cast("int")


def first_author(authors: Column) -> Column:
    """the first author of a list, by semicolons, else by commas, in plain form."""
    a = F.trim(F.coalesce(authors, F.lit("")))
    return plain_title(F.when(a.contains(";"), F.substring_index(a, ";", 1)).otherwise(F.substring_index(a, ",", 1)))


def surname_matches(surname: Column, authors: Column) -> Column:
    """whether a surname is among the words of the first author."""
    s = plain_title(surname)
    return (s != "") & F.concat(F.lit(" "), first_author(authors), F.lit(" ")).contains(F.concat(F.lit(" "), s, F.lit(" ")))


def header_title(text: Column) -> Column:
    """the first line of 25 to 300 characters without a DOI or an address."""
    found = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: F.length(x).between(25, 300) & ~x.rlike(r"10\.\d{4,9}/") & ~x.contains("@"))
    return F.coalesce(F.regexp_replace(F.get(found, 0), r"\s+", " "), F.lit(""))


def header_year(text: Column, now: int) -> Column:
    """the latest year of a text that is no later than ``now``."""
    years = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(?:19|20)\d\d\b"), F.lit(0)), lambda y: y.cast("int")), lambda y: y <= now)
    return F.array_max(years)


def header_abstract(text: Column) -> Column:
    """what stands between the heading Abstract and the next one, words broken at lines joined; 80 characters at least."""
    body = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?is)\babstract\b[ \t]*[:.]?\s*\n?(.*?)(?:\n\s*(?:keywords?|introduction|background|1\.?\s+introduction)\b|$)", 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(body, r"(\w)-\s*\n\s*(\w)", "$1$2"), r"\s+", " "))
    return F.when(F.length(plain) >= 80, plain).otherwise("")
