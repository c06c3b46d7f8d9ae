"""Mentions and their groups: reading forms, grouping, corpus index, mappings, judgement, chunks, operation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.shared import written

_WRAP = r"([A-Za-z]+)-[ \t]*\n[ \t]*([A-Za-z]+)"
#: Where a mention without a start stands.
LAST = 10**12


def vocabulary(*texts: Column) -> Column:
    """F8: words and hyphenated compounds of a document as it writes them where lines don't break."""
    joined = F.lower(F.concat_ws(" ", *texts))
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(joined, "[-­][ \t]*\n", "\u0001"), F.lit("[a-z]+(?:-[a-z]+)*"), F.lit(0)))


def reading_form(surface: Column, known: Column | None = None) -> Column:
    """F8: a surface as it is read: a hyphen at a line's end is kept or goes as the document writes the word elsewhere.

    Without evidence two words of four letters or more, or a capital after the break, keep it; a fragment is joined.
    """
    known = F.array().cast("array<string>") if known is None else F.coalesce(known, F.array().cast("array<string>"))
    plain = F.replace(F.coalesce(surface, F.lit("")), F.lit("­"), F.lit(""))
    part = lambda k: F.regexp_extract_all(plain, F.lit(_WRAP), F.lit(k))
    breaks = F.arrays_zip(part(0).alias("w"), part(1).alias("a"), part(2).alias("b"))

    def fixed(x: Column) -> Column:
        joined, kept = F.concat(x["a"], x["b"]), F.concat(x["a"], F.lit("-"), x["b"])
        has = lambda word: F.array_contains(known, F.lower(word))
        whole = ((F.length(x["a"]) >= 4) & (F.length(x["b"]) >= 4)) | ~x["b"].rlike("^[a-z]")
        return F.when(has(joined) & ~has(kept), joined).when(has(kept), kept).when(whole, kept).otherwise(joined)

    undone = F.aggregate(breaks, plain, lambda s, x: F.replace(s, x["w"], fixed(x)))
    joined = F.when(plain.contains("\n"), F.regexp_replace(undone, r"(\w)-[ \t]*\n[ \t]*(\w)", "$1-$2")).otherwise(plain)
    return F.trim(F.regexp_replace(joined, r"\s+", " "))


def keyed(mentions: DataFrame, entity: str = "entity", known: Column | None = None) -> DataFrame:
    """Mentions with an entity, with ``reading``, its reading form, and the group's ``form``, ``label`` and ``referent``."""
    found = mentions.where(F.coalesce(entity, F.lit("")) != "").withColumn("reading", reading_form(F.col(entity), known))
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return found.withColumn("form", F.lower("reading")).withColumn("label", blank(F.col("label"))).withColumn("referent", blank(F.col("referent")))


KEY = ["form", "label", "referent"]


def _read_once(keyed_rows: DataFrame, *columns: str) -> DataFrame:
    """Mentions with their keys, their reading and some columns, written: readings cost most, and are needed twice."""
    return written(keyed_rows.select(*dict.fromkeys([*KEY, "reading", "position", *columns])), "mentions")


def canonical(keyed_rows: DataFrame, key: list[str]) -> DataFrame:
    """A2: the group's reading that is most common, then longest, then first; counted before it is chosen."""
    counts = keyed_rows.groupBy(*key, "reading").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"))
    return counts.groupBy(*key).agg(F.max_by("reading", F.struct("n", F.length("reading"), -F.col("first"))).alias("surface"))


def groups(keyed_rows: DataFrame) -> DataFrame:
    """A1: one row for each form, label and referent of mentions (position, judge_score, source_model, ontology_id, ...).

    Scores are rounded half to even; the mapping is that of the highest score among mapped mentions, the first of equals.
    """
    keyed_rows = _read_once(keyed_rows, "judge_score", "source_model", "ontology_id", "sentence")
    mapped = F.when(F.coalesce("ontology_id", F.lit("")) != "", F.struct(F.coalesce("judge_score", F.lit(0.0)), -F.col("position")))
    scores = [F.bround(f("judge_score"), 3).alias(f"judge_score_{n}") for n, f in (("max", F.max), ("avg", F.avg), ("min", F.min))]
    model = F.nullif(F.col("source_model"), F.lit(""))
    found = keyed_rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("mention_count"), F.size(F.collect_set(model)).cast("long").alias("consensus_count"), *scores, F.max_by("ontology_id", mapped).alias("ontology_id"), F.count_distinct("sentence").alias("sentences"), F.array_join(F.array_sort(F.collect_set(model)), ",").alias("source_models"))
    return found.join(canonical(keyed_rows, KEY), KEY)


def sentence_locations(keyed_rows: DataFrame) -> DataFrame:
    """A1: sentences of each group once, with the places they stand in, in order of first use."""
    once = keyed_rows.where("sentence is not null").groupBy(*KEY, "sentence", "paper_location").agg(F.min("position").alias("first"))
    placed = F.when(F.col("paper_location").isNotNull(), F.struct("first", "paper_location"))
    return once.groupBy(*KEY, "sentence").agg(F.array_join(F.transform(F.array_sort(F.collect_list(placed)), lambda x: x["paper_location"]), ",").alias("locations"))


def mapping_quality(provenance: Column, iri: Column, label: Column) -> Column:
    """A4: 100 for a tool, 25 for a model's knowledge; 50 for a real id; 10 for a label."""
    real = lambda c, none: ~F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(*none)
    none = ["n/a", "none", "null", ""]
    return F.when(provenance == "tool", 100).when(provenance == "llm_knowledge", 25).otherwise(0) + F.when(real(iri, none), 50).otherwise(0) + F.when(real(label, none), 10).otherwise(0)


def unified(keyed_rows: DataFrame, fields: list[str]) -> DataFrame:
    """A3: every mention with the mapping of its group's best one, the first of equals; no mention is lost."""
    quality = mapping_quality(F.col("concept_mapping_provenance"), F.col("ontology_id"), F.col("ontology_label"))
    keyed_rows = _read_once(keyed_rows, *keyed_rows.columns)
    best = keyed_rows.groupBy(*KEY).agg(F.max_by(F.struct(*fields), F.struct(quality, -F.col("position"))).alias("_best"))
    return keyed_rows.join(best, KEY).select(*[c for c in keyed_rows.columns if c not in fields], *[F.col(f"_best.{f}").alias(f) for f in fields])


def corpus_index(keyed_rows: DataFrame) -> DataFrame:
    """A5: forms and labels over documents: counts, ids that tools gave, whether these differ, specificity if unanimous."""
    own = F.when(~F.coalesce(F.col("concept_mapping_provenance").isin("llm_knowledge", "validation_failed"), F.lit(False)), F.nullif(F.trim("ontology_id"), F.lit("")))
    key = ["form", "label"]
    rows = _read_once(keyed_rows, "doc", "concept_mapping_provenance", "ontology_id", "specificity").withColumn("_id", own)
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("mention_count"), F.count_distinct("doc").alias("document_count"), F.array_sort(F.collect_set("_id")).alias("ids"), F.array_sort(F.collect_set("specificity")).alias("specifics"))
    found = counts.join(canonical(rows, key), key)
    return found.select(*key, "surface", "mention_count", "document_count", F.array_join("ids", ",").alias("ontology_ids"), (F.size("ids") > 1).alias("ontology_conflict"), F.when(F.size("specifics") == 1, F.col("specifics")[0]).alias("specificity"))


def corpus_totals(keyed_rows: DataFrame) -> DataFrame:
    """Totals from the items themselves: documents, mentions, unique forms, mapped and unmapped, mentions a form."""
    mapped = ~F.coalesce(F.col("concept_mapping_provenance").isin("llm_knowledge", "validation_failed"), F.lit(False)) & (F.coalesce(F.trim("ontology_id"), F.lit("")) != "")
    found = keyed_rows.agg(F.count_distinct("doc").alias("documents"), F.count(F.lit(1)).alias("mentions"), F.count_distinct("form", "label").alias("forms"), F.count_if(mapped).alias("mapped"))
    return found.withColumn("unmapped", F.col("mentions") - F.col("mapped")).withColumn("mentions_a_form", F.bround(F.try_divide("mentions", "forms"), 2))


def in_order(keyed_rows: DataFrame) -> DataFrame:
    """Groups by where they first stand, each with its id ``surface|label``; without a start they come last."""
    keyed_rows = _read_once(keyed_rows, "start")
    first = keyed_rows.groupBy(*KEY).agg(F.min(F.coalesce("start", F.lit(LAST))).alias("first"))
    found = first.join(canonical(keyed_rows, KEY), KEY)
    identity = F.concat("surface", F.lit("|"), F.col("label"), F.when(F.col("referent") != "", F.concat(F.lit("|referent="), "referent")).otherwise(""))
    return found.select(*KEY, identity.alias("id"), "first")


def grounding(items: DataFrame) -> DataFrame:
    """Verdict on each group of (id, anchored, missing): all missing fails, all anchored passes, else a flag."""
    found = items.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchored").alias("anchored"), F.count_if(F.col("missing") & ~F.col("anchored")).alias("missing"))
    return found.withColumn("verdict", F.when(F.col("missing") == F.col("n"), "fail").when(F.col("anchored") == F.col("n"), "pass").otherwise("flag"))


# What a verdict counts, and how bad it is.
SCORES = {"pass": 1.0, "flag": 0.5, "fail": 0.0}


def first_reviews(reviews: DataFrame) -> DataFrame:
    """The first review of each judge and item, ids compared in lower case; others of the same judge don't count.

    Of reviews at one place the first by verdict, confidence and reason counts, so that runs agree.
    """
    order = F.row_number().over(Window.partitionBy("judge", F.lower("id")).orderBy("place", "verdict", "confidence", "reason"))
    return reviews.where(F.col("verdict").isin(*SCORES)).withColumn("_k", order).where("_k = 1").drop("_k").withColumn("id", F.lower("id"))


def unknown_judges(reviews: DataFrame, judges: DataFrame) -> DataFrame:
    """Judges that have no weights; their reviews are refused."""
    return reviews.join(judges, "judge", "left_anti").select("judge").distinct()


def combined(reviews: DataFrame, judges: DataFrame) -> DataFrame:
    """(id, score, remarks, dropped, dropped_by, reason) of reviews by weighted judges.

    A fail by a critical judge drops the item; the row stays, with who dropped it and why. Remarks name judges and
    verdicts in order, then the reason of the first fail, else of the first flag, in 280 characters.
    """
    rows = first_reviews(reviews).join(judges, "judge").withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
    value = F.when(F.col("verdict") == "pass", 1.0).when(F.col("verdict") == "flag", 0.5).otherwise(0.0)
    gate = F.coalesce("critical", F.lit(False)) & (F.col("verdict") == "fail")
    said = F.array_sort(F.collect_list(F.struct("judge", "verdict")))
    worst = lambda v: F.min_by("reason", F.when(F.col("verdict") == v, F.col("place")))
    has = lambda v: F.bool_or(F.col("verdict") == v)
    found = rows.groupBy("id").agg(
        F.bround(F.try_divide(F.sum(F.col("weight") * F.col("confidence") * value), F.sum("weight")), 4).alias("score"), F.array_join(F.transform(said, lambda x: F.concat_ws(":", x["judge"], x["verdict"])), ", ").alias("_said"),
        F.when(has("fail"), worst("fail")).when(has("flag"), worst("flag")).alias("_why"), F.bool_or(gate).alias("dropped"), F.array_join(F.array_sort(F.collect_set(F.when(gate, F.col("judge")))), ",").alias("dropped_by"), F.min_by("reason", F.when(gate, F.col("place"))).alias("reason"),
    )
    tail = F.when(F.coalesce("_why", F.lit("")) != "", F.concat(F.lit(" — "), "_why")).otherwise("")
    return found.select("id", "score", F.substring(F.concat("_said", tail), 1, 280).alias("remarks"), "dropped", "dropped_by", "reason")


def operations(found: DataFrame) -> DataFrame:
    """The operation that a combined verdict asks for: drop, approve from 0.75, else a note to review."""
    op = F.when(F.col("dropped"), "drop").when(F.col("score") >= 0.75, "approve").otherwise("note")
    return found.select("id", op.alias("op"), F.when(op == "drop", F.coalesce("reason", F.lit(""))).when(op == "note", F.col("remarks")).otherwise("").alias("reason"))


def review_queue(rows: DataFrame, threshold: float) -> DataFrame:
    """What a human should see, most urgent first: escalated, then by score; what was dropped comes last.

    rows: (id, score, escalated, reviewed, dropped). ``place`` is the order within each of the three parts.
    """
    part = F.when(F.col("dropped"), 2).when(F.col("escalated"), 0).otherwise(1)
    wanted = rows.where("dropped or ((escalated or score < %s) and not reviewed)" % threshold).withColumn("part", part)
    return wanted.select("id", "part", F.coalesce("score", F.lit(1.0)).alias("urgency"))


def resolved(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """Relations with the one group that their target names: in the sentence, else by surface, else by its plural.

    relations: (rel, source, target, sentence); mentions: (group, surface, sentence). A target that more than one group
    has is left open, as is one that none has.
    """
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    held = mentions.select("group", plain(F.col("surface")).alias("t"), "sentence").distinct()
    asked = relations.withColumn("t", plain(F.col("target")))
    other = F.when(F.col("t").endswith("s"), F.expr("substring(t, 1, length(t) - 1)")).otherwise(F.concat("t", F.lit("s")))

    def unique(name: str, left: DataFrame, keys: list[str], right: DataFrame) -> DataFrame:
        met = left.join(right, keys).where(F.col("group") != F.col("source")).groupBy("rel").agg(F.count_distinct("group").alias("n"), F.min("group").alias("g"))
        return met.select("rel", F.when(F.col("n") == 1, F.col("g")).alias(name), F.col("n").alias(f"{name}_n"))

    surfaces = held.select("group", "t").distinct()
    tiers = [unique("local", asked, ["t", "sentence"], held), unique("same", asked, ["t"], surfaces), unique("plural", asked.withColumn("t", other), ["t"], surfaces)]
    found = asked
    for tier in tiers:
        found = found.join(tier, "rel", "left")
    # A surface of several groups is ambiguous, and its plural is not tried.
    target = F.coalesce("local", "same", F.when(F.col("same_n").isNull(), F.col("plural")))
    return found.select("rel", "source", "target", target.alias("resolved"))


def fold_log(ops: DataFrame) -> DataFrame:
    """K1: one row for each operation of a log with its result, and the state of its item after it.

    ops: (id, place, actor, op, field, value). Operations of an item apply in order: ``approve`` and ``note`` leave it,
    ``drop`` takes it out, ``restore`` brings it back, for a human and only if it was dropped, ``set`` and ``remap`` give
    a field or the mapping, ``demote`` clears the mapping; on a dropped item only ``restore`` applies.
    """
    start = F.struct(F.lit(False).alias("dropped"), F.lit(None).cast("string").alias("label"), F.lit("initial").alias("mapping"), F.array().cast("array<struct<place:bigint,result:string,dropped:boolean,label:string,mapping:string>>").alias("log"))

    def step(state: Column, x: Column) -> Column:
        known = x["op"].isin("approve", "drop", "restore", "set", "demote", "remap", "note")
        result = (
            F.when(~known, "rejected: unknown operation")
            .when((x["op"] == "restore") & (x["actor"] != "human"), "rejected: only a human restores")
            .when((x["op"] == "restore") & ~state["dropped"], "rejected: was not dropped")
            .when((x["op"] != "restore") & state["dropped"], "rejected: is dropped")
            .when((x["op"] == "set") & (F.coalesce(x["field"], F.lit("")) != "label"), "rejected: no such field")
            .when((x["op"] == "remap") & (F.coalesce(x["value"], F.lit("")) == ""), "rejected: no value")
            .otherwise("applied")
        )
        done = result == "applied"
        dropped = F.when(done & (x["op"] == "drop"), True).when(done & (x["op"] == "restore"), False).otherwise(state["dropped"])
        label = F.when(done & (x["op"] == "set"), x["value"]).otherwise(state["label"])
        mapping = F.when(done & (x["op"] == "remap"), x["value"]).when(done & (x["op"] == "demote"), F.lit(None)).otherwise(state["mapping"])
        entry = F.struct(x["place"].alias("place"), result.alias("result"), dropped.alias("dropped"), label.alias("label"), mapping.alias("mapping"))
        return F.struct(dropped.alias("dropped"), label.alias("label"), mapping.alias("mapping"), F.array_append(state["log"], entry).alias("log"))

    lists = ops.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "actor", "op", "field", "value"))).alias("ops"))
    return lists.select("id", F.explode(F.aggregate("ops", start, step)["log"]).alias("x")).select("id", "x.*")


# Tokens whose period ends no sentence.
PROTECTED = "fig figs tab tabs eq eqs ref refs sec secs ch chap suppl e.g i.e cf vs viz etc approx ca no nos al dr prof mr mrs ms st jr sr vol vols p pp min sec hr hrs wk wks mo mos yr yrs i.p i.v s.c i.c.v p.o a.m p.m u.s".split()


def sentence_spans(text: Column) -> Column:
    """(start, end) of a text's sentences: split after .!? before white space and a capital, quote or bracket.

    Not after a protected token or an initial. Splits are marked first, then the marks give the offsets.
    """
    words = "|".join(sorted({w.replace(".", r"\.") for w in PROTECTED}, key=lambda w: (-len(w), w)))
    rx = rf"(?<=[.!?])(?<!(?<![A-Za-z.])(?i:{words}|[a-z])\.)(\s+)(?=[A-Z(\"'\[])"
    pieces = F.split(F.regexp_replace(text, rx, "\u0001$1\u0001"), "\u0001")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("got"))
    walked = F.aggregate(pieces, start, lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.when(F.trim(p, F.lit(" \n\t\r")) == "", a["got"]).otherwise(F.array_append(a["got"], F.struct(a["at"].alias("s"), (a["at"] + F.length(p)).alias("e")))).alias("got")))
    return walked["got"]


def chunk_spans(text: Column, most: int, overlap: int = 1) -> Column:
    """(start, end) of chunks: sentences are packed greedily first, then each chunk takes ``overlap`` sentences of the
    one before, but starts after that one's first; a text that fits, or has no sentences, is one chunk."""
    whole = F.array(F.struct(F.lit(0).alias("s"), F.length(text).alias("e")))
    spans = sentence_spans(text)

    def packed(s: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.array().cast("array<struct<a:int,b:int>>").alias("g"))

        def step(a: Column, x: Column) -> Column:
            last = F.element_at(a["g"], -1)
            joins = (F.size(a["g"]) > 0) & (x["e"] - F.get(s, last["a"])["s"] <= most)
            grown = F.concat(F.slice(a["g"], 1, F.greatest(F.size(a["g"]) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), a["i"].alias("b"))))
            return F.struct((a["i"] + 1).alias("i"), F.when(joins, grown).otherwise(F.array_append(a["g"], F.struct(a["i"].alias("a"), a["i"].alias("b")))).alias("g"))

        return F.aggregate(s, start, step)["g"]

    def laid(s: Column) -> Column:
        made = F.transform(F.array(packed(s)), lambda g: F.transform(g, lambda x, k: F.struct(F.get(s, F.when(k > 0, F.greatest(F.get(g, k - 1)["a"] + 1, x["a"] - overlap)).otherwise(x["a"]))["s"].alias("s"), F.get(s, x["b"])["e"].alias("e"))))
        return F.element_at(made, 1)

    chunks = F.element_at(F.transform(F.array(spans), lambda s: F.when(F.size(s) > 0, laid(s)).otherwise(whole)), 1)
    return F.when(F.length(text) <= most, whole).otherwise(chunks)
