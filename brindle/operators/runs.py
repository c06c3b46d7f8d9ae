"""Runs and their logs: diagnostics of a slice, signals that break it, budgets of polls, batches of tasks, compute used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which category of signal decides, lowest first.
PRIORITY = {"governance": 0, "correctness": 1, "budget": 2, "engineering": 3, "validity": 4}


def failures_in_slice(rows: DataFrame) -> DataFrame:
    """(run, failures): rows (run, at, started, failed) that failed in a row at the end of the current slice.

    The slice is what stands at or after ``started``; without it, everything. Failures after the last row that did not fail
    are counted, with no window over the log.
    """
    inside = rows.where("started is null or at >= started")
    last = inside.groupBy("run").agg(F.max(F.when(~F.col("failed"), F.struct("at", "place"))).alias("_ok"))
    found = inside.join(last, "run").groupBy("run").agg(F.count_if(F.col("_ok").isNull() | (F.struct("at", "place") > F.col("_ok"))).alias("failures"))
    return rows.select("run").distinct().join(found, "run", "left").select("run", F.coalesce("failures", F.lit(0)).alias("failures"))


def pace(rows: DataFrame, now: Column) -> DataFrame:
    """(run, last_age, avg_gap) in whole seconds: of the last five gaps of the slice, its start being the first point."""
    inside = rows.where("started is null or at >= started").select("run", "at", "place")
    starts = rows.where("started is not null").select("run", F.col("started").alias("at"), F.lit(-1).cast("long").alias("place")).distinct()
    order = Window.partitionBy("run").orderBy("at", "place")
    gaps = inside.unionByName(starts).withColumn("gap", F.greatest(F.lit(0), F.col("at") - F.lag("at").over(order))).withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("at"), F.desc("place"))))
    recent = gaps.where("gap is not null and k <= 5").groupBy("run").agg(F.floor(F.sum("gap") / F.count("gap")).alias("avg_gap"))
    last = inside.unionByName(starts).groupBy("run").agg(F.greatest(F.lit(0), now - F.max("at")).alias("last_age"))
    return rows.select("run").distinct().join(last, "run", "left").join(recent, "run", "left")


def signals(rows: DataFrame, reserve: int, warn: float, stall: int, most_rss: int, most_failures: int, patience: int, guardrail: float, least_trust: float) -> DataFrame:
    """(run, category, code, severity) of each run's state: budgets, pace, stall, memory, failures, plateau, guardrail,
    governance. rows: (run, budget, remaining, avg_gap, last_age, peak_rss, failures, since, latest, direction, decision,
    trust, drift). A warning of the budget is given only when it is not spent."""
    left = F.col("remaining") - reserve
    item = lambda when, category, code, severity="break": F.when(when, F.struct(F.lit(category).alias("category"), F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    worse = ((F.col("direction") == "higher") & (F.col("latest") < guardrail)) | ((F.col("direction") == "lower") & (F.col("latest") > guardrail))
    found = F.array_compact(
        F.array(
            item(left <= 0, "budget", "budget_exhausted"),
            item((left > 0) & (F.col("budget") > 0) & (F.col("budget") - F.col("remaining") >= warn * F.col("budget")), "budget", "budget_warning", "warn"),
            item((F.col("avg_gap") > 0) & (F.col("avg_gap") > F.greatest(left, F.lit(0))), "engineering", "pace_insufficient_budget"),
            item(F.col("last_age") > stall, "engineering", "stalled"),
            item(F.col("peak_rss") > most_rss, "engineering", "resource_rss"),
            item(F.col("failures") >= most_failures, "correctness", "repeated_failures"),
            item(F.col("direction").isin("higher", "lower") & (F.col("since") >= patience), "validity", "no_improvement"),
            item(worse, "validity", "guardrail_violation"),
            item(F.coalesce("drift", F.lit(False)), "governance", "drift_detected"),
            item(F.col("trust") < least_trust, "governance", "low_trust"),
            item(F.lower(F.trim("decision")) == "block", "governance", "blocked"),
            item(F.lower(F.trim("decision")) == "warn", "governance", "governance_warning", "warn"),
        )
    )
    return rows.select("run", F.explode(found).alias("s")).select("run", "s.*")


def decisions(runs: DataFrame, found: DataFrame) -> DataFrame:
    """(run, decision, category): break with the category that decides, warn, or continue."""
    rank = F.lit(99)
    for name, place in PRIORITY.items():
        rank = F.when(F.col("category") == name, place).otherwise(rank)
    own = found.groupBy("run").agg(F.min_by("category", F.when(F.col("severity") == "break", rank)).alias("category"), F.bool_or(F.col("severity") == "break").alias("_b"), F.bool_or(F.col("severity") == "warn").alias("_w"))
    joined = runs.select("run").distinct().join(own, "run", "left")
    decision = F.when(F.coalesce("_b", F.lit(False)), "break").when(F.coalesce("_w", F.lit(False)), "warn").otherwise("continue")
    return joined.select("run", decision.alias("decision"), F.when(decision == "break", F.col("category")).alias("category"))


def polls(items: DataFrame, budget: int) -> DataFrame:
    """(source, item, poll) of details that each poll's budget of calls reads, the oldest first; what is over is
    carried to the next. items: (source, item, updated_at, calls)."""
    spent = F.sum("calls").over(Window.partitionBy("source").orderBy("updated_at", "item").rowsBetween(Window.unboundedPreceding, 0))
    return items.select("source", "item", F.floor((spent - 1) / budget).alias("poll"))


def next_tasks(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """(job, task): each job's first open task all of whose needed tasks were accepted. tasks: (job, task, place, state)."""
    open_tasks = tasks.where("state in ('waiting', 'rejected')")
    accepted = tasks.where("state = 'accepted'").select("job", F.col("task").alias("need"))
    blocked = needs.join(accepted, ["job", "need"], "left_anti").select("job", "task")
    ready = open_tasks.join(blocked, ["job", "task"], "left_anti")
    return ready.groupBy("job").agg(F.min_by("task", "place").alias("task"))


def compute_used(rows: DataFrame) -> DataFrame:
    """(run, seconds, best, best_row) of rows (run, row, seconds, metric, direction); the first of equal rows."""
    usable = F.when(~F.isnan("metric"), F.struct(F.when(F.col("direction") == "higher", -F.col("metric")).otherwise(F.col("metric")).alias("m"), "row"))
    found = rows.groupBy("run").agg(F.sum("seconds").alias("seconds"), F.min(usable).alias("x"), F.min("direction").alias("direction"))
    return found.select("run", "seconds", F.when(F.col("direction") == "higher", -F.col("x.m")).otherwise(F.col("x.m")).alias("best"), F.col("x.row").alias("best_row"))


def cards(edges: DataFrame, entities: DataFrame, assays: DataFrame, sets: DataFrame, panels: DataFrame) -> DataFrame:
    """One card an edge (e, assay, node), with its marker set and its panel; ``NA`` where there is none."""
    found = edges.join(entities, "e").join(assays, "assay").join(sets, "node", "left").join(panels, "assay", "left")
    return found.select("e", "label", "assay", "kind", "node", F.coalesce("markers", F.lit("NA")).alias("markers"), F.coalesce("panel", F.lit("NA")).alias("panel"))


def roles_of_variables(uses: DataFrame, variables: DataFrame) -> DataFrame:
    """(use, variable) by a variable's wording, else by its measure; several of them are settled by the stated role.

    uses: (use, name, role); variables: (variable, wording, measure, role). What stays open with several is null. Names are
    counted before uses are joined, so a name that many variables have is one row for a use. A use that stands for several
    rows is judged by all of them.
    """

    def by(key: str) -> DataFrame:
        # Only whether a name, or a name in a role, has one variable is asked: the least and the greatest tell.
        ends = [F.min("variable").alias("low"), F.max("variable").alias("high")]
        named = variables.groupBy(F.col(key).alias("name")).agg(*ends)
        roled = variables.groupBy(F.col(key).alias("name"), F.col("role")).agg(F.min("variable").alias("role_low"), F.max("variable").alias("role_high"))
        met = uses.join(named, "name").join(roled, ["name", "role"], "left")
        found = met.groupBy("use").agg(*[f(c).alias(c) for f, c in ((F.min, "low"), (F.max, "high"), (F.min, "role_low"), (F.max, "role_high"))])
        return found.select("use", F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col("role_low") == F.col("role_high"), F.col("role_low")).alias(key), F.lit(True).alias(f"_{key}"))

    found = uses.join(by("wording"), "use", "left").join(by("measure"), "use", "left")
    return found.select("use", F.when(F.col("_wording"), F.col("wording")).otherwise(F.col("measure")).alias("variable"))


def after(text: Column, mark: str) -> Column:
    """STRAFTER: what follows the first mark; empty without one."""
    place = F.instr(text, mark)
    return F.when(place > 0, F.substring(text, place + len(mark), F.length(text))).otherwise("")


def before(text: Column, mark: str) -> Column:
    """STRBEFORE: what stands before the first mark; empty without one."""
    place = F.instr(text, mark)
    return F.when(place > 0, F.substring(text, F.lit(1), place - 1)).otherwise("")


def reference(style: str, authors: Column, year: Column, title: Column, journal: Column, doi: Column) -> Column:
    """a reference in a style; parts that are missing are left out with their signs."""
    part = lambda c, start="", end="": F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(start), c.cast("string"), F.lit(end))).otherwise("")
    link = part(doi, " https://doi.org/")
    if style == "apa":
        return F.trim(F.concat(authors, part(year, " (", ")."), part(title, " ", "."), part(journal, " ", "."), link))
    if style == "nature":
        return F.trim(F.concat(authors, part(title, " ", "."), part(journal, " "), part(year, " (", ")."), link))
    if style == "vancouver":
        return F.trim(F.concat(authors, F.lit("."), part(title, " ", "."), part(journal, " ", "."), part(year, " ", "."), link))
    return F.trim(F.concat(authors, part(title, ', "', ',"'), part(journal, " ", ","), part(year, " ", "."), link))


def captions(text: Column) -> Column:
    """(figures, tables, cited): captions of a text, and figures and tables that it refers to."""
    count = lambda rx: F.regexp_count(text, F.lit(rx))
    cited = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:fig(?:ure)?|table)\.?\s+(\d+)"), F.lit(0))
    return F.struct(count(r"(?im)^\s*fig(?:ure)?\.?\s+\d+").alias("figures"), count(r"(?im)^\s*table\.?\s+\d+").alias("tables"), F.size(F.array_distinct(F.transform(cited, lambda c: F.lower(F.regexp_replace(F.trim(c, F.lit(" \n")), r"(?i)figure|fig\.", "fig"))))).alias("cited"))


def of_kinds(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tables in one, with their kind; columns that one lacks are null there."""
    found = None
    for kind, rows in parts.items():
        own = rows.withColumn("kind", F.lit(kind))
        found = own if found is None else found.unionByName(own, allowMissingColumns=True)
    return found


def catalogue(queries: dict[str, tuple[DataFrame | None, str]]) -> list[tuple[str, str, int]]:
    """(name, status, rows) of prepared queries: answered, empty, unavailable without what it needs, or error."""
    out = []
    for name, (rows, _) in queries.items():
        if rows is None:
            out.append((name, "unavailable", 0))
            continue
        try:
            n = rows.count()
            out.append((name, "answered" if n else "empty", n))
        except Exception:  # noqa: BLE001  the report says that the query failed
            out.append((name, "error", 0))
    return out
