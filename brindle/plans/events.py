"""Queries over events: telemetry, sessions, routing, leases, credit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators import entities, ordered
from brindle.sources.tables import read

# Subscriptions: subscriber, kind of event, tier.
SUBSCRIPTIONS = [("ada", "purchase", "team"), ("ada", "error", "team"), ("bo", "signup", "public"), ("cy", "purchase", "restricted"), ("cy", "view", "public")]


def running_best(spark: SparkSession, sf: str) -> DataFrame:
    """Best value of each user so far, and events since it rose."""
    rows = read(spark, sf, "events", "event_id", "user_id", "ts", "value")
    return ordered.running_best(rows, ["user_id"], ["ts", "event_id"], "value").select("event_id", "best_before", "improved", F.col("since_improved").cast("long").alias("since_improved"))


BEST = """
WITH b AS (SELECT event_id, user_id, ts, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
i AS (SELECT *, best_before IS NULL OR value > best_before AS improved FROM b)
SELECT event_id, best_before, improved, k - max(CASE WHEN improved THEN k END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since_improved FROM i
"""


def trailing_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of each user since its last event of another kind."""
    rows = read(spark, sf, "events", "event_id", "user_id", "ts", "event_type")
    return ordered.trailing_failures(rows, ["user_id"], F.struct("ts", "event_id"), F.col("event_type") == "error")


TRAILING = """
WITH l AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS last, arg_max(event_id, (ts, event_id)) FILTER (event_type <> 'error') AS last_id FROM events GROUP BY 1)
SELECT l.user_id, count(e.event_id) AS trailing FROM l LEFT JOIN events e ON e.user_id = l.user_id AND e.event_type = 'error' AND (l.last IS NULL OR (e.ts, e.event_id) > (l.last, l.last_id)) GROUP BY 1
"""


def pace_last_five(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of a user's last five gaps, in whole seconds."""
    rows = read(spark, sf, "events", "event_id", "user_id", "ts")
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.timestamp_diff("SECOND", F.lag("ts").over(by_time), F.col("ts"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    last = rows.withColumn("gap", gap).withColumn("k", place).where("k <= 5 and gap is not null")
    return last.groupBy("user_id").agg(F.floor(F.sum("gap") / F.count(F.lit(1))).cast("long").alias("pace"), F.max("ts").alias("last_ts"))


PACE = """
WITH g AS (SELECT user_id, ts, date_sub('second', lag(ts) OVER w, ts) AS gap, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, floor(sum(gap) / count(*))::BIGINT AS pace, max(ts) AS last_ts FROM g WHERE k <= 5 AND gap IS NOT NULL GROUP BY 1
"""


def break_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of each user: errors, spending, stall; the one of highest priority decides."""
    rows = read(spark, sf, "events", "user_id", "ts", "event_type", "value")
    end = rows.agg(F.max("ts").alias("end"))
    state = rows.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 2).alias("spent"), F.max("ts").alias("last"))
    joined = state.join(F.broadcast(end))  # a single row
    signal = lambda cond, name, level, rank: F.when(cond, F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("reason"), F.lit(level).alias("level")))
    found = F.array_compact(F.array(signal(F.col("errors") >= 5, "correctness", "break", 1), signal(F.col("spent") > 3000, "budget", "warn", 2), signal(F.timestamp_diff("HOUR", F.col("last"), F.col("end")) > 48, "engineering", "warn", 3)))
    first = F.array_min(found)
    return joined.select("user_id", "errors", "spent", F.size(found).cast("long").alias("signals"), F.coalesce(first["reason"], F.lit("none")).alias("reason"), F.coalesce(first["level"], F.lit("continue")).alias("decision"))


SIGNALS = """
WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 2) AS spent, max(ts) AS last FROM events GROUP BY 1),
f AS (SELECT *, errors >= 5 AS a, spent > 3000 AS b, date_diff('second', last, (SELECT max(ts) FROM events)) // 3600 > 48 AS c FROM s)
SELECT user_id, errors, spent, (a::INT + b::INT + c::INT)::BIGINT AS signals, CASE WHEN a THEN 'correctness' WHEN b THEN 'budget' WHEN c THEN 'engineering' ELSE 'none' END AS reason,
       CASE WHEN a THEN 'break' WHEN b OR c THEN 'warn' ELSE 'continue' END AS decision FROM f
"""


def session_state_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Users by the state of their last beat: active, waiting or stale."""
    rows = read(spark, sf, "events", "user_id", "ts")
    last = rows.groupBy("user_id").agg(F.max("ts").alias("last"))
    age = F.timestamp_diff("HOUR", F.col("last"), F.col("end"))
    state = F.when(age < 6, "active").when(age < 24, "waiting").otherwise("stale")
    return last.join(F.broadcast(last.agg(F.max("last").alias("end")))).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("users"))


STATES = """
WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), a AS (SELECT date_diff('second', last, (SELECT max(ts) FROM events)) // 3600 AS age FROM l)
SELECT CASE WHEN age < 6 THEN 'active' WHEN age < 24 THEN 'waiting' ELSE 'stale' END AS state, count(*) AS users FROM a GROUP BY 1
"""


def latest_lease(spark: SparkSession, sf: str) -> DataFrame:
    """Holder of each lease, a kind of event and an hour: the latest writer whose lease outlasts the hour."""
    rows = read(spark, sf, "events", "event_id", "user_id", "ts", "event_type", "value").withColumn("hour", F.hour("ts"))
    minutes = F.minute("ts") + F.floor(F.col("value")).cast("int") % 60
    return rows.where(minutes >= 60).groupBy("event_type", "hour").agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("holder"), F.max("ts").alias("since"))


LEASES = """
SELECT event_type, hour(ts)::INTEGER AS hour, arg_max(user_id, (ts, event_id)) AS holder, max(ts) AS since FROM events WHERE minute(ts) + floor(value)::INTEGER % 60 >= 60 GROUP BY 1, 2
"""


def event_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries of events to subscribers, by day; more than twenty become one digest."""
    rows = read(spark, sf, "events", "event_id", "user_id", "ts", "event_type", "value")
    wants = spark.createDataFrame(SUBSCRIPTIONS, "subscriber string, event_type string, tier string")
    hit = rows.join(F.broadcast(wants), "event_type").where((F.col("tier") != "restricted") | (F.col("value") > 50))
    counts = hit.groupBy("subscriber", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"))
    return counts.withColumn("mode", F.when(F.col("events") > 20, "digest").otherwise("single"))


ROUTING = f"""
WITH s(subscriber, event_type, tier) AS (VALUES {', '.join(str(x) for x in SUBSCRIPTIONS)})
SELECT subscriber, ts::DATE AS day, count(*) AS events, min(event_id) AS first_event, CASE WHEN count(*) > 20 THEN 'digest' ELSE 'single' END AS mode
FROM events JOIN s USING (event_type) WHERE tier <> 'restricted' OR value > 50 GROUP BY 1, 2
"""


def dedupe_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """First event of each user, kind and day."""
    rows = read(spark, sf, "events", "event_id", "user_id", "ts", "event_type").withColumn("day", F.col("ts").cast("date"))
    return rows.groupBy("user_id", "event_type", "day").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("seen"))


DEDUPE = "SELECT user_id, event_type, ts::DATE AS day, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS seen FROM events GROUP BY 1, 2, 3"


def contribution_credit(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of events of each user in a fixed order, and how many; views alone are no contribution."""
    rows = read(spark, sf, "events", "user_id", "event_type")
    order = ["signup", "purchase", "error", "click", "view"]
    counts = rows.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in order])
    kinds = F.array_join(F.array_compact(F.array(*[F.when(F.col(k) > 0, F.lit(k)) for k in order])), ",")
    return counts.withColumn("kinds", kinds).where("kinds != 'view'").select("user_id", "kinds", sum((F.col(k) for k in order[1:]), F.col(order[0])).alias("n"))


CREDIT = """
WITH k AS (SELECT user_id, event_type, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS o, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS kinds, sum(n)::BIGINT AS n FROM k GROUP BY 1 HAVING string_agg(event_type, ',' ORDER BY o) <> 'view'
"""


def score_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Events by kind and bucket of their value as a score of a hundred."""
    rows = read(spark, sf, "events", "event_type", "value")
    v = F.col("value") / 100
    bucket = F.when(F.col("value").isNull(), "missing").when(v >= 1, "1.00").when(v >= 0.85, "0.85-0.99").when(v >= 0.65, "0.65-0.84").when(v >= 0.4, "0.40-0.64").otherwise("<0.40")
    return rows.groupBy("event_type", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("events"))


BUCKETS = """
SELECT event_type, CASE WHEN value IS NULL THEN 'missing' WHEN value / 100 >= 1 THEN '1.00' WHEN value / 100 >= 0.85 THEN '0.85-0.99' WHEN value / 100 >= 0.65 THEN '0.65-0.84' WHEN value / 100 >= 0.4 THEN '0.40-0.64' ELSE '<0.40' END AS bucket, count(*) AS events FROM events GROUP BY 1, 2
"""


def interval_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of a user's day, an event and its value in minutes, that no longer span of the day contains.

    Containment is decided by the furthest end among spans that begin no later, in one pass over a day.
    """
    rows = read(spark, sf, "events", "event_id", "user_id", "ts", "value")
    start = F.hour("ts") * 60 + F.minute("ts")
    spans = rows.select("event_id", "user_id", F.col("ts").cast("date").alias("day"), start.alias("start"), (start + F.floor("value").cast("int")).alias("end"))
    order = Window.partitionBy("user_id", "day").orderBy("start", F.desc("end"), "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reach", F.max("end").over(order)).where("reach is null or reach < end").select("event_id", "day", "start", "end")


CONTAINED = """
WITH s AS (SELECT event_id, user_id, ts::DATE AS day, (hour(ts) * 60 + minute(ts))::INTEGER AS start, (hour(ts) * 60 + minute(ts) + floor(value))::INTEGER AS "end" FROM events),
m AS (SELECT *, max("end") OVER (PARTITION BY user_id, day ORDER BY start, "end" DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT event_id, day, start, "end" FROM m WHERE reach IS NULL OR reach < "end"
"""

def range_conflict(spark: SparkSession, sf: str) -> DataFrame:
    """The first error of a user that begins within a purchase's next hours, as many as its value.

    The first error after each event is a running minimum from the end, so the range join is one ordered pass.
    """
    rows = read(spark, sf, "events", "event_id", "user_id", "ts", "event_type", "value")
    after = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    first = F.min(F.when(F.col("event_type") == "error", F.col("ts"))).over(after)
    wanted = rows.withColumn("conflict", first).where("event_type = 'purchase' and conflict > ts")
    return wanted.where(F.timestamp_diff("SECOND", F.col("ts"), F.col("conflict")) <= F.col("value") * 3600).select("event_id", "user_id", "conflict")


CONFLICT = """
SELECT p.event_id, p.user_id, min(e.ts) AS conflict FROM events p JOIN events e ON e.user_id = p.user_id AND e.event_type = 'error' AND e.ts > p.ts AND date_sub('second', p.ts, e.ts) <= p.value * 3600
WHERE p.event_type = 'purchase' GROUP BY 1, 2
"""

QUERIES = {
    "range_conflict": (range_conflict, CONFLICT),
    "running_best": (running_best, BEST),
    "trailing_failures": (trailing_failures, TRAILING),
    "pace_last_five": (pace_last_five, PACE),
    "break_signals": (break_signals, SIGNALS),
    "session_state_counts": (session_state_counts, STATES),
    "latest_lease": (latest_lease, LEASES),
    "event_routing": (event_routing, ROUTING),
    "dedupe_first_seen": (dedupe_first_seen, DEDUPE),
    "contribution_credit": (contribution_credit, CREDIT),
    "score_buckets": (score_buckets, BUCKETS),
    "interval_containment": (interval_containment, CONTAINED),
}
