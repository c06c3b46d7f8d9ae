"""Terms against a lexicon: normal forms and variants, ranked lookup with ambiguity, a waterfall of sources, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Greek letters as they are spelled out, and accented letters with their plain ones.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "κ": "kappa", "λ": "lambda", "μ": "mu", "σ": "sigma", "ω": "omega"}
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def normal(text: Column) -> Column:
    """lower case, Greek letters spelled out, accents off, everything but a-z and 0-9 as single spaces."""
    s = F.lower(F.coalesce(text, F.lit("")))
    for letter, name in GREEK.items():
        s = F.replace(s, F.lit(letter), F.lit(name))
    return F.trim(F.regexp_replace(F.translate(s, *ACCENTS), "[^a-z0-9]+", " "))


def split_camel(text: Column) -> Column:
    """a space between a small and a capital letter, and before the last of several capitals that a word begins with."""
    return F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")


def singular(words: Column) -> Column:
    """The last word's singular forms, at most two, in order; none for -ss, -us and -is."""
    head, last = F.regexp_extract(words, r"^(.*?)(\S+)$", 1), F.regexp_extract(words, r"(\S+)$", 1)
    ies = F.when((F.length(last) > 4) & last.endswith("ies"), F.concat(head, F.regexp_replace(last, "ies$", "y")))
    plain = F.when((F.length(last) > 3) & last.endswith("s") & ~last.rlike("(ss|us|is)$"), F.concat(head, F.regexp_replace(last, "s$", "")))
    return F.array_compact(F.array(ies, plain))


def variants(term: Column) -> Column:
    """(key, rank) to look a term up by: as written and with camel case split, 0; their singulars, 1."""
    written = F.filter(F.array_distinct(F.array(normal(term), normal(split_camel(term)))), lambda x: x != "")
    single = F.array_except(F.array_distinct(F.flatten(F.transform(written, singular))), written)
    rank = lambda xs, n: F.transform(xs, lambda x: F.struct(x.alias("key"), F.lit(n).alias("variant_rank")))
    return F.concat(rank(written, 0), rank(single, 1))


def lexicon(classes: DataFrame) -> DataFrame:
    """(source, key, iri, prefix, match_type, label) of classes (source, iri, prefix, match_type, value, label), each once."""
    forms = F.filter(F.array_distinct(F.array(normal(F.col("value")), normal(split_camel(F.col("value"))))), lambda x: x != "")
    return classes.select("source", F.explode(forms).alias("key"), "iri", "prefix", "match_type", "label").distinct()


# How good a match is, best first; the last three are weak and only count where nothing else is found.
MATCHES = ["label", "exact_synonym", "symbol", "broad_synonym", "narrow_synonym", "related_synonym"]
STRONG = 3


def candidates(terms: DataFrame, entries: DataFrame, sources: DataFrame, routes: DataFrame, short: int = 3) -> DataFrame:
    """Entries that a term's variants meet, with their rank: source, route, match type, variant.

    terms: (term, label); sources: (source, priority); routes: (label, prefix, route_rank). A label with routes takes their
    prefixes only; a term of ``short`` letters or fewer needs a label with routes. Weak matches stay only where no strong
    one is found.
    """
    routed = routes.select("label").distinct().withColumn("routed", F.lit(True))
    asked = terms.distinct().join(routed, "label", "left").where(F.col("routed").isNotNull() | (F.length(F.regexp_replace("term", "[^A-Za-z0-9]", "")) > short))
    keys = asked.select("term", "label", "routed", F.explode(variants(F.col("term"))).alias("v")).select("term", "label", "routed", "v.key", "v.variant_rank")
    met = keys.join(entries.withColumnRenamed("label", "concept_label"), "key").join(sources, "source").join(routes, ["label", "prefix"], "left")
    met = met.where("routed is null or route_rank is not null")
    place = F.array_position(F.array(*[F.lit(m) for m in MATCHES]), F.col("match_type")) - 1
    found = met.withColumn("match_rank", place.cast("int")).where("match_rank >= 0").withColumn("route_rank", F.coalesce("route_rank", F.lit(0)))
    best = found.groupBy("term", "label").agg(F.min("match_rank").alias("_m"))
    strong = found.join(best, ["term", "label"]).where(f"_m >= {STRONG} or match_rank < {STRONG}").drop("_m")
    return strong.select("term", "label", "iri", "concept_label", "source", "prefix", "match_type", F.struct("priority", "route_rank", "match_rank", "variant_rank").alias("rank"))


def lookup(terms: DataFrame, found: DataFrame, most: int = 10) -> DataFrame:
    """O2: the one concept of the best rank of each term; several of that rank make it ambiguous, and are listed."""
    best = found.groupBy("term", "label").agg(F.min("rank").alias("best"))
    top = found.join(best, ["term", "label"]).where("rank = best").groupBy("term", "label").agg(F.array_sort(F.collect_set("iri")).alias("iris"), F.min("concept_label").alias("concept_label"), F.min("match_type").alias("match_type"), F.min("source").alias("source"))
    one = F.size("iris") == 1
    joined = terms.distinct().join(top, ["term", "label"], "left")
    status = F.when(F.col("iris").isNull(), "unmapped").when(one, "mapped").otherwise("ambiguous")
    only = lambda c: F.when(one, F.col(c)).alias(c)
    return joined.select("term", "label", status.alias("status"), F.when(one, F.col("iris")[0]).alias("iri"), only("concept_label"), only("match_type"), only("source"), F.when(~one, F.array_join(F.slice("iris", 1, most), ",")).alias("candidates"))


def waterfall(terms: DataFrame, stages: list[DataFrame]) -> DataFrame:
    """Each term's iri by the first stage that has it, and the number of that stage; stages are (term, iri).

    One join over all stages with their numbers, not a pass over what each stage leaves.
    """
    both = None
    for k, stage in enumerate(stages):
        part = stage.select("term", F.lit(k).alias("stage"), "iri")
        both = part if both is None else both.unionByName(part)
    first = both.groupBy("term").agg(F.min(F.struct("stage", "iri")).alias("x"))
    return terms.distinct().join(first, "term", "left").select("term", "x.iri", "x.stage")


def compacted(iris: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(iri, curie) by the longest namespace that the IRI begins with; null where none is.

    prefixes: (prefix, namespace). Namespaces end after ``/``, ``#`` or ``_``, so an IRI's own
    starts of that kind are looked up by equality, longest first.
    """
    ends = F.filter(F.sequence(F.lit(1), F.length("iri") - 1), lambda k: F.substring("iri", k, F.lit(1)).isin("/", "#", "_"))
    starts = iris.distinct().select("iri", F.explode(F.transform(ends, lambda k: F.substring("iri", F.lit(1), k))).alias("namespace"))
    best = starts.join(prefixes, "namespace").groupBy("iri").agg(F.max_by(F.struct("prefix", "namespace"), F.length("namespace")).alias("x"))
    curie = F.concat("x.prefix", F.lit(":"), F.expr("substring(iri, length(x.namespace) + 1)"))
    return iris.distinct().join(best, "iri", "left").select("iri", curie.alias("curie"))


def expanded(curies: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(curie, iri) of CURIEs by their prefix, whatever its case; null for an unknown one."""
    prefix = F.lower(F.substring_index("curie", ":", 1))
    known = prefixes.select(F.lower("prefix").alias("_p"), "namespace")
    return curies.distinct().join(known, prefix == F.col("_p"), "left").select("curie", F.concat("namespace", F.expr("substring(curie, instr(curie, ':') + 1)")).alias("iri"))


IRI = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]+$"


def iri_problem(iri: Column, patterns: dict[str, str]) -> Column:
    """Why an IRI can't stand: malformed, or not of the pattern of its ontology; null if it can."""
    found = F.when(~F.coalesce(iri.rlike(IRI), F.lit(False)), "malformed")
    for start, pattern in patterns.items():
        found = found.when(iri.startswith(start) & ~iri.rlike(pattern), "not a term")
    return found


def demoted(rows: DataFrame, iri: str, patterns: dict[str, str]) -> DataFrame:
    """Rows with a null in place of an IRI that can't stand, and the reason beside it."""
    why = iri_problem(F.col(iri), patterns)
    return rows.withColumn("demoted_reason", F.when(F.col(iri).isNotNull(), why)).withColumn(iri, F.when(F.col("demoted_reason").isNull(), F.col(iri)))


def namespace_roles(entries: DataFrame) -> DataFrame:
    """Of each source the namespace with most terms, the share it has, and how many others there are."""
    counts = entries.select("source", "iri", F.regexp_extract("iri", r"^(.*[/#_])", 1).alias("namespace")).distinct().groupBy("source", "namespace").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("source").agg(F.sum("n").alias("terms"), F.count(F.lit(1)).alias("namespaces"), F.min(F.struct((-F.col("n")).alias("least"), "namespace")).alias("x"))
    return total.select("source", F.col("x.namespace").alias("dominant"), F.round(-F.col("x.least") / F.col("terms"), 4).alias("share"), (F.col("namespaces") - 1).alias("others"))


def defined(text: Column) -> Column:
    """(short, long) of definitions ``long form (SF)``: the letters of SF stand in order in a start of the words before.

    The start whose first letter is SF's is sought from the last word backwards, over as many words as SF has letters and
    three more. Short forms need a capital, and two letters both.
    """
    rx = r"([A-Za-z0-9][A-Za-z0-9\-–' ]{2,80}?)\s*\(\s*([A-Za-z][A-Za-z0-9\-+/]{1,11}?)s?\s*[;,)]"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(rx), F.lit(1)).alias("before"), F.regexp_extract_all(text, F.lit(rx), F.lit(2)).alias("short"))
    usable = F.filter(found, lambda x: x["short"].rlike("[A-Z]") & ((F.length(x["short"]) > 2) | x["short"].rlike("^[A-Z0-9]+$")))

    def long_form(x: Column) -> Column:
        words, letters = F.split(F.trim(x["before"]), r"\s+"), F.lower(F.regexp_replace(x["short"], "[^A-Za-z0-9]", ""))
        in_order = F.concat(F.lit("^"), F.regexp_replace(letters, "(.)", "$1.*"))
        n = F.size(words)
        starts = F.sequence(n, F.greatest(F.lit(1), n - F.length(letters) - 2), F.lit(-1))
        held = F.filter(F.transform(starts, lambda k: F.array_join(F.slice(words, k, n), " ")), lambda c: F.regexp(F.lower(c), in_order))
        return F.get(held, 0)

    made = F.transform(usable, lambda x: F.struct(x["short"].alias("short"), long_form(x).alias("long")))
    return F.filter(made, lambda x: x["long"].isNotNull() & (F.lower(x["long"]) != F.lower(x["short"])) & (F.length(x["long"]) > F.length(x["short"])))


def abbreviations(rows: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, short, long) of short forms with one long form in their document; others are left out."""
    found = rows.select(doc, F.explode(defined(F.col(text))).alias("x")).select(doc, "x.short", "x.long")
    return found.groupBy(doc, "short").agg(F.count_distinct(F.lower("long")).alias("n"), F.min("long").alias("long")).where("n = 1").drop("n")
