"""Small values: durations, sizes, dates, hashes, JSON, waves, names, types, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _n(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("long"), F.lit(0).cast("long"))


def walltime_seconds(text: Column) -> Column:
    """seconds of ``MM``, ``MM:SS``, ``HH:MM:SS`` and ``D-HH[:MM[:SS]]``; null if unlimited or anything else."""
    t = F.lower(F.trim(text))
    days = _n(t, r"^(\d+)-") * 86400 + _n(t, r"^\d+-(\d+)") * 3600 + _n(t, r"^\d+-\d+:(\d+)") * 60 + _n(t, r"^\d+-\d+:\d+:(\d+)")
    return F.when(t.rlike(r"^\d+$"), _n(t, r"^(\d+)$") * 60).when(t.rlike(r"^\d+:\d+$"), _n(t, r"^(\d+):") * 60 + _n(t, r":(\d+)$")).when(t.rlike(r"^\d+:\d+:\d+$"), _n(t, r"^(\d+):") * 3600 + _n(t, r"^\d+:(\d+):") * 60 + _n(t, r":(\d+)$")).when(t.rlike(r"^\d+-(\d+(:\d+){0,2})?$"), days)


def human_bytes(n: Column) -> Column:
    """bytes in the largest unit of which there is one, with one decimal; whole bytes without."""
    found = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(["KB", "MB", "GB", "TB"], 1):
        found = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", n / float(1024**k))).otherwise(found)
    return found


def human_seconds(n: Column) -> Column:
    """``1h 02m 03s``, without leading units that are zero."""
    h, m, s = (n / 3600).cast("long"), ((n % 3600) / 60).cast("long"), (n % 60).cast("long")
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s)).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))


def any_time(text: Column) -> Column:
    """a time from the forms that registries write, in UTC; null for none of them."""
    t = F.trim(text)
    forms = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd MMM yyyy", "yyyy-MM", "yyyy"]
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms])


def fixed_utc(moment: Column) -> Column:
    """a time in fixed width, so that its text sorts as it does."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def content_id(prefix: str, text: Column, width: int = 10) -> Column:
    """a prefix and the first hexadecimal digits of a text's SHA-1."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(text), 1, width))


def uuid5(namespace: str, name: Column) -> Column:
    """the version 5 UUID of a name within a namespace, itself a UUID: SHA-1 over both, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8).cast("long")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def loose_json(text: Column, schema: str) -> Column:
    """JSON that stands alone, within a fence, or cut off after a whole element of its last array or object."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(" \n\t\r"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)^.*?```(?:json)?\s*\n", ""), r"(?s)\n```.*$", ""), F.lit(" \n\t\r"))
    sound = lambda s: F.when(F.try_parse_json(s).isNotNull() & s.rlike(r"^[\[{]"), F.from_json(s, schema))
    closed = lambda end: F.concat(F.regexp_replace(bare, r"(?s),?\s*[^,}\]]*$", ""), F.lit(end))
    return F.coalesce(sound(t), sound(bare), *[sound(closed(end)) for end in ("", "}", "]", "]}", "}]", "}]}", "}}")])


def last_metric(text: Column, name: str = "metric") -> Column:
    """the finite number of the last line that isn't blank, alone or as a field of an object; null otherwise."""
    rows = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")
    last = F.trim(F.element_at(F.concat(F.array(F.lit("")), rows), -1))
    value = F.coalesce(last.try_cast("double"), F.get_json_object(last, f"$.{name}").try_cast("double"))
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value)


def metric(text: Column) -> Column:
    """A finite number, else null."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def largest_int(text: Column) -> Column:
    """The largest whole number of a text, thousands separated or not."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d[\d,]*"), F.lit(0))
    return F.array_max(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("long")))


def leading_number(text: Column) -> Column:
    """The number that a text begins with."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([+-]?\d+(?:\.\d+)?)", 1).try_cast("double")


def token_estimate(text: Column, a_token: float = 4.0) -> Column:
    """tokens of a text, by characters."""
    return F.ceil(F.length(text) / a_token).cast("long")


def chunk_size(window: Column, prompt: Column, share: float = 0.5, least: int = 500, most: int = 16000) -> Column:
    """characters of a chunk that leaves room for prompt and answer in a context of ``window`` tokens, within bounds."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor((window - prompt) * share * 4))).cast("long")


def context_window(model: Column, known: list[tuple[str, int]], default: int = 128_000) -> Column:
    """P20: the window of the first entry, most specific first, that a model's name holds."""
    found = F.lit(default)
    for name, size in reversed(known):
        found = F.when(F.lower(F.coalesce(model, F.lit(""))).contains(name.lower()), size).otherwise(found)
    return found


def wave(text: Column) -> Column:
    """(order, first, last, ambiguous, multiple) of a wave's wording: baseline, then follow-up, ordinal, and year.

    Order is waves since baseline. Two waves joined by and, to, through, a comma or & are a span, and have no order; cues
    that differ without being joined are ambiguous, unless one is the baseline.
    """
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    every = lambda rx, less: F.transform(F.regexp_extract_all(t, F.lit(rx), F.lit(1)), lambda x: x.cast("int") - less)
    base = F.when(t.rlike(r"(?i)\bbaseline\b"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    follow = every(r"(?i)\b(\d+)[\s-]*(?:year|yr|y)[\s-]*(?:follow[\s-]*up|fu)\b", 0)
    ordinal = F.filter(every(r"(?i)\b(?:time|wave|t)[\s-]?(\d+)\b", 1), lambda x: x >= 0)
    year = F.filter(every(r"(?i)\byear[\s-]?(\d+)\b", 0), lambda x: x >= 1)
    cues = F.array_distinct(F.concat(base, follow, ordinal, year))
    order = F.coalesce(*[F.array_min(x) for x in (base, follow, ordinal, year)])
    many = F.size(cues) > 1
    joined = many & t.rlike(r"(?i)\band\b|,|through|\bto\b|&")
    return F.struct(
        F.when(~joined, order).alias("order"), F.when(joined, F.array_min(cues)).alias("first"), F.when(joined, F.array_max(cues)).alias("last"),
        (many & ~joined & (F.size(base) == 0)).alias("ambiguous"), joined.alias("multiple"),
    )


def holds_name(name: Column, within: Column) -> Column:
    """whether all words of a name, but for acronyms in brackets, stand in another."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(c, r"\([A-Z0-9-]+\)", " ")), "[^a-z0-9]+"), lambda x: x != ""))
    return (F.size(words(name)) > 0) & (F.size(F.array_except(words(name), words(within))) == 0)


def task_type(fields: dict[str, Column]) -> Column:
    """What a result is of, by the first of its fields that is filled: entities, resources, activity, else unknown."""
    found = F.lit("unknown")
    for name, kind in (("items", "structured"), ("activity", "structured"), ("resources", "resource"), ("entities", "ner")):
        if name in fields:
            found = F.when(F.coalesce(F.size(fields[name]), F.lit(0)) > 0, kind).otherwise(found)
    return found


def generic(span: Column, heads: list[str], adjectives: list[str]) -> Column:
    """Whether a span is a bare head, or a quantifier, general adjectives and a head: nothing that can be named."""
    quantifiers = "all|some|many|most|several|few|both|each|every|other|these|those|various|different|the|a|an"
    head, adjective = "|".join(heads), "|".join(adjectives)
    return F.lower(F.trim(span)).rlike(f"^(?:(?:{quantifiers})\\s+)*(?:(?:{adjective})\\s+)*(?:{head})$")


def scope(section: Column, sentence: Column) -> Column:
    """Whether a statement is of the paper's own study, of cited work, or unclear, by section, citation and wording."""
    cited = sentence.rlike(r"\[\d+(?:[,–-]\s*\d+)*\]|\([A-Z][A-Za-z'-]+(?: et al\.?| and [A-Z][a-z]+)?,? \d{4}\)")
    own = sentence.rlike(r"(?i)\b(?:we|our|here,? we|in this study|the present study)\b")
    background = F.lower(F.coalesce(section, F.lit(""))).rlike("introduction|background|discussion|related")
    return F.when(own & ~cited, "own").when(cited & ~own, "cited").when(own & cited, F.when(background, "cited").otherwise("own")).when(background, "unclear").otherwise("own")


def first_filled(*values: Column) -> Column:
    """The first value that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(v.cast("string")), F.lit("")) for v in values])


def identity(doi: Column, title: Column, path: Column, name: Column) -> Column:
    """(id, source) of a document: its DOI, else title, else path, else file name."""
    filled = [(F.nullif(F.trim(v), F.lit("")), s) for v, s in ((doi, "doi"), (title, "paper_title"), (path, "source_path"), (name, "filename"))]
    source = F.lit(None).cast("string")
    for value, kind in reversed(filled):
        source = F.when(value.isNotNull(), kind).otherwise(source)
    return F.struct(F.coalesce(*[v for v, _ in filled]).alias("id"), source.alias("source"))


def harvested(candidates: list[tuple[str, Column]]) -> Column:
    """(value, source) of a field: the first source in order that has it."""
    source = F.lit(None).cast("string")
    for name, value in reversed(candidates):
        source = F.when(F.nullif(F.trim(value), F.lit("")).isNotNull(), name).otherwise(source)
    return F.struct(first_filled(*[v for _, v in candidates]).alias("value"), source.alias("source"))


def windows(text: Column, width: int, overlap: int) -> Column:
    """(start, piece) of a text in windows of ``width`` characters that share ``overlap``; one for a shorter text."""
    last = F.greatest(F.lit(0), F.length(text) - overlap - 1)
    return F.transform(F.sequence(F.lit(0), last, F.lit(width - overlap)), lambda k: F.struct(k.alias("start"), F.substring(text, k + 1, F.lit(width)).alias("piece")))


def head_and_tail(text: Column, most: int) -> Column:
    """a text of ``most`` characters or fewer as it is, else its two ends of half as many, with a mark between."""
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.lit(" … "), F.right(text, F.lit(half))))


def tolerant(surface: Column) -> Column:
    """an expression that finds a surface whatever white space, hyphens and line breaks stand between its words."""
    words = F.filter(F.split(F.coalesce(surface, F.lit("")), r"[\s\-–—]+"), lambda w: w != "")
    safe = F.transform(words, lambda w: F.regexp_replace(w, r"([^A-Za-z0-9])", r"\\$1"))
    return F.concat(F.lit(r"(?i)(?<![A-Za-z0-9-])"), F.array_join(safe, r"[\s\-–—]+"), F.lit(r"(?![A-Za-z_])"))


def manifest_problems(entry: Column, duplicate: Column) -> Column:
    """P5: what is wrong with a manifest entry (name, source, url, sha): keys, name, repeats, type, link, hash."""
    blank = lambda c: F.coalesce(F.trim(entry[c]), F.lit("")) == ""
    return F.array_compact(
        F.array(
            *[F.when(blank(c), F.lit(f"no {c}")) for c in ("name", "source", "url")],
            F.when(~blank("name") & ~entry["name"].rlike(r"^[a-z0-9][a-z0-9-]*$"), F.lit("bad name")),
            F.when(duplicate, F.lit("repeated name")),
            F.when(~blank("source") & ~entry["source"].isin("git", "archive"), F.lit("unknown source")),
            F.when(~blank("url") & ~entry["url"].startswith("https://"), F.lit("not https")),
            F.when(~entry["sha"].rlike("^[0-9a-f]{40}$"), F.lit("bad hash")),
        )
    )
