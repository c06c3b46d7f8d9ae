"""Claims and values against their evidence, and a small language of conditions and derived numbers over tables."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import evidence as ev


def matches(value: Column, condition: Any, many: bool = False) -> Column:
    """Whether a value meets a condition: a value (equal, whatever case and spaces), a list of them, or a dict.

    A dict's keys are ``contains``, ``regex``, ``not``, ``empty``, ``gt``, ``gte``, ``lt`` and ``lte``; all must hold. With
    ``many`` the value is an array, of which any element may do.
    """
    if many:
        return F.exists(value, lambda v: matches(v, condition))
    text = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    if isinstance(condition, list):
        return text.isin(*[str(c).strip().lower() for c in condition])
    if not isinstance(condition, dict):
        return text == str(condition).strip().lower()
    number = text.try_cast("double")
    parts = {
        "contains": lambda x: text.contains(str(x).lower()),
        "regex": lambda x: F.coalesce(value.cast("string"), F.lit("")).rlike(f"(?i){x}"),
        "not": lambda x: ~matches(value, x),
        "empty": lambda x: (text == "") == F.lit(bool(x)),
        "gt": lambda x: F.coalesce(number > x, F.lit(False)),
        "gte": lambda x: F.coalesce(number >= x, F.lit(False)),
        "lt": lambda x: F.coalesce(number < x, F.lit(False)),
        "lte": lambda x: F.coalesce(number <= x, F.lit(False)),
    }
    return reduce(lambda a, b: a & b, [parts[op](x) for op, x in condition.items()], F.lit(True))


def field(rows: DataFrame, path: str) -> Column:
    """The column at a path ``a.b.0.c``, numbers being places of arrays."""
    parts = path.split(".")
    found = F.col(f"`{parts[0]}`")
    for part in parts[1:]:
        found = F.get(found, int(part)) if part.isdigit() else found[part]
    return found


def selected(rows: DataFrame, where: dict[str, Any]) -> DataFrame:
    """Rows for which every condition holds, by path."""
    arrays = {c for c, kind in rows.dtypes if kind.startswith("array")}
    return rows.where(reduce(lambda a, b: a & b, [matches(field(rows, p), c, p in arrays) for p, c in where.items()], F.lit(True)))


def derived(sources: dict[str, DataFrame], name: str, expression: dict[str, Any]) -> DataFrame:
    """One row (name, value) of an expression: ``count``, ``distinct``, ``sum``, ``mean``, ``median``, ``min`` or
    ``max`` of a field of a named source with a where, or ``percent`` or ``ratio`` of two expressions."""
    (op, arg), = expression.items()
    if op in ("percent", "ratio"):
        a, b = (derived(sources, name, x).select(F.lit(1).alias("k"), F.col("value").alias(c)) for x, c in zip(arg, "ab"))
        return a.join(b, "k").select(F.lit(name).alias("name"), F.try_divide(F.col("a") * (100.0 if op == "percent" else 1.0), F.col("b")).alias("value"))
    rows = selected(sources[arg["from"]], arg.get("where", {}))
    if op == "count":
        return rows.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("name"), "value")
    value = field(rows, arg["field"])
    text = F.lower(F.trim(value.cast("string")))
    number = F.regexp_replace(value.cast("string"), ",", "").try_cast("double")
    made = {"distinct": F.count_distinct(F.when(text != "", text)).cast("double"), "sum": F.sum(number), "mean": F.avg(number), "median": F.median(number), "min": F.min(number), "max": F.max(number)}[op]
    return rows.agg(made.alias("value")).select(F.lit(name).alias("name"), "value")


def having(rows: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """(field, value) pairs of which exactly ``n`` rows have one, of fewer than 60 characters."""
    cells = rows.select(*[F.trim(F.col(c).cast("string")).alias(c) for c in columns]).unpivot([], columns, "field", "value")
    kept = cells.where((F.coalesce("value", F.lit("")) != "") & (F.length("value") < 60))
    return kept.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select("field", "value")


def value_statuses(values: DataFrame, quotes: DataFrame, studies: DataFrame) -> DataFrame:
    """Each value's status: an absence, grounded, or ungrounded with the reason.

    values: (id, study, value); quotes: (id, study, quote); studies: (study, text). A quote counts if it is of the value's
    study and stands in its text; then the value's quantities must be in the quotes, and its shares within one of them.
    """
    own = quotes.withColumnRenamed("study", "of").join(values.select("id", "study"), "id")
    # Texts are made uniform once, and searched once for each different quote of a study.
    uniform = studies.select(F.col("study").alias("of"), ev.normal(F.coalesce("text", F.lit(""))).alias("words"))
    asked = own.select("of", "quote").distinct().withColumn("sought", ev.normal(F.col("quote")))
    found = asked.join(uniform, "of").select("of", "quote", ev.within(F.col("sought"), F.col("words")).alias("stands"))
    own = own.join(found, ["of", "quote"], "left")
    good = (F.col("study").isNull() | (F.col("of") == F.col("study"))) & F.coalesce("stands", F.lit(False))
    held = own.select("id", "quote", good.alias("good")).groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("good"), F.col("quote")))).alias("good"), F.count_if(~F.col("good")).alias("bad"))
    found = values.join(held, "id", "left").withColumn("good", F.coalesce("good", F.array().cast("array<string>")))
    lost, apart = F.size(ev.missing(F.col("value"), F.array_join("good", "\n"))), F.size(ev.unpaired(F.col("value"), F.col("good")))
    status = F.when(ev.is_absent(F.col("value")), "absence").when(F.size("good") == 0, "ungrounded").when(lost > 0, "ungrounded").when(apart > 0, "ungrounded").otherwise("grounded")
    reason = F.when(ev.is_absent(F.col("value")), "").when(F.size("good") == 0, F.when(F.coalesce("bad", F.lit(0)) > 0, "no quote stands").otherwise("no quote")).when(lost > 0, "quantity in no quote").when(apart > 0, "share not in one quote").otherwise("")
    return found.select("id", "value", status.alias("status"), reason.alias("reason"))


def status_counts(found: DataFrame, kind: str) -> DataFrame:
    """Values by kind and status."""
    return found.groupBy(kind, "status").agg(F.count(F.lit(1)).alias("n"))


def span_counts(spans: DataFrame) -> DataFrame:
    """Spans by how they match, and how many studies each kind of match has."""
    return spans.groupBy("match").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("study").alias("studies"))


def grounded_only(found: DataFrame) -> DataFrame:
    """K5: values with a marker in place of the ungrounded ones, and whether they were replaced."""
    gone = F.col("status") == "ungrounded"
    return found.select("id", F.when(gone, ev.UNGROUNDED).otherwise(F.col("value")).alias("value"), gone.alias("replaced"))


def claim_audit(claims: DataFrame, quotes: DataFrame, derivations: DataFrame) -> DataFrame:
    """V7: (claim, code) of what is wrong with judged claims (claim, text, support).

    Unjudged, contradicted and insufficient claims are found as such; a supported one needs a quote that stands in its
    study (quotes: claim, quote, stands), every quantity in a quote or in a derivation that gives it within half of its
    last decimal (derivations: claim, value), and both numbers of a share in one quote.
    """
    held = quotes.where("stands").groupBy("claim").agg(F.array_sort(F.collect_list("quote")).alias("quotes"))
    made = derivations.groupBy("claim").agg(F.collect_list("value").alias("values"))
    found = claims.join(held, "claim", "left").join(made, "claim", "left").withColumn("quotes", F.coalesce("quotes", F.array().cast("array<string>"))).withColumn("values", F.coalesce("values", F.array().cast("array<double>")))
    near = lambda q: F.exists("values", lambda v: F.abs(v - F.when(q["sign"] == "-", -q["value"]).otherwise(q["value"])) <= 0.5 * F.pow(F.lit(10.0), -q["decimals"]) + 1e-9)
    lost = F.filter(ev.missing(F.col("text"), F.array_join("quotes", "\n")), lambda q: ~near(q))
    support = F.coalesce("support", F.lit(""))
    supported = support.isin("supported", "partially_supported")
    codes = F.array_compact(
        F.array(
            F.when(support == "", F.lit("unjudged")),
            F.when(support.isin("contradicted", "insufficient"), support),
            F.when(supported & (F.size("quotes") == 0), F.lit("no-quote")),
            F.when((supported | (support == "derived")) & (F.size(lost) > 0), F.lit("quantity-unsupported")),
            F.when(supported & (F.size(ev.unpaired(F.col("text"), F.col("quotes"))) > 0) & (F.size("quotes") > 0), F.lit("share-unpaired")),
        )
    )
    return found.select("claim", F.explode(codes).alias("code"))


def flow_checks(flow: DataFrame) -> DataFrame:
    """(review, check) of arithmetic that fails in a review's flow; a zero or missing count is not checked.

    flow: (review, identified, duplicates, after_dedup, sought, not_retrieved, assessed, excluded, included, articles).
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    failed = F.array_compact(
        F.array(
            F.when(n("included") != n("articles"), F.lit("included is not what the review holds")),
            F.when((n("sought") > 0) & (n("sought") - n("not_retrieved") != n("assessed")), F.lit("sought less not retrieved is not assessed")),
            F.when((n("assessed") > 0) & (n("assessed") - n("excluded") != n("included")), F.lit("assessed less excluded is not included")),
            F.when((n("identified") > 0) & (n("after_dedup") > 0) & (n("identified") - n("duplicates") != n("after_dedup")), F.lit("identified less duplicates is not what is left")),
        )
    )
    return flow.select("review", F.explode(failed).alias("check"))


def identification(found: DataFrame, declared: DataFrame, totals: DataFrame) -> DataFrame:
    """(review, source, n) of records by database, a declared count standing for the found one, with what is left after deduplication.

    totals: (review, duplicates, articles).
    """
    counts = found.groupBy("review", "source").agg(F.count(F.lit(1)).alias("n")).join(declared.withColumnRenamed("n", "told"), ["review", "source"], "full").withColumn("n", F.coalesce("told", "n")).drop("told")
    sums = counts.groupBy("review").agg(F.sum("n").alias("identified")).join(totals, "review")
    left = F.greatest(F.col("identified") - F.col("duplicates"), F.col("articles"))
    return counts.join(sums.select("review", "identified", left.alias("after_dedup")), "review")


def by_question(answers: DataFrame) -> DataFrame:
    """Study-first answers (study, answers: map of question to text) as question-first rows, empty ones left out."""
    return answers.select("study", F.explode("answers").alias("question", "answer")).where(F.trim(F.coalesce("answer", F.lit(""))) != "")
