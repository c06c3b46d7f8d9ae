"""Work items, events and their texts, made from the order and event tables and asked about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import work
from brindle.sources import lines as ln
from brindle.sources.tables import read


def item_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """An item's tier and whether it may go where it is to; unknown visibility fails closed on both sides."""
    rows = read(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN 'internal' END AS visibility", "CASE WHEN o_orderkey % 5 = 0 THEN array('tier:restricted', 'bug') WHEN o_orderkey % 5 = 1 THEN array('tier:lab') ELSE array('tier:odd') END AS labels",
        "CASE o_orderkey % 7 WHEN 0 THEN 'lab' WHEN 1 THEN 'restricted' WHEN 2 THEN 'odd' END AS declared", "o_orderkey % 3 = 0 AS external", "o_orderkey % 2 = 0 AS opt_in", "CASE o_custkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' END AS to_visibility", "CASE o_custkey % 4 WHEN 0 THEN 'restricted' END AS override",
    )
    tier, to = work.tier_of(*[F.col(c) for c in ("visibility", "labels", "declared", "external", "opt_in")]), work.destination_tier(F.col("to_visibility"), F.col("override"), F.lit(None).cast("string"))
    return rows.select("o_orderkey", tier.alias("tier"), to.alias("to_tier"), work.may_deliver(tier, to).alias("may_deliver"))


TIERS = """
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 OR (o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 AND o_orderkey % 2 <> 0) THEN 2
  ELSE greatest(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END, CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END, CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) END AS a,
  greatest(CASE WHEN o_custkey % 3 = 1 THEN 1 ELSE 0 END, CASE WHEN o_custkey % 4 = 0 THEN 2 ELSE 0 END) AS b FROM orders)
SELECT o_orderkey, (['public', 'lab', 'restricted'])[a + 1] AS tier, (['public', 'lab', 'restricted'])[b + 1] AS to_tier, b >= a AS may_deliver FROM r
"""


def combined_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """The tier of each day's digest: the strictest of its items, an unknown one counting as restricted."""
    rows = read(spark, sf, "events").selectExpr("user_id", "CASE event_type WHEN 'click' THEN 'public' WHEN 'view' THEN 'lab' WHEN 'error' THEN 'odd' ELSE 'public' END AS tier")
    return work.combined_tier(rows, "user_id")


COMBINED = "SELECT user_id, (['public', 'lab', 'restricted'])[max(CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 0 END) + 1] AS tier FROM events GROUP BY 1"

_ITEMS = """SELECT concat('org/r', o_custkey % 6) AS repo, CASE WHEN o_orderkey % 5 = 0 THEN 'release' ELSE 'issue' END AS kind, o_orderkey AS number, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state, o_orderkey % 10 = 0 AS draft,
    cast(o_orderdate AS date) AS created_at, CASE WHEN o_orderstatus = 'F' THEN cast(o_orderdate AS date) END AS closed_at, cast(o_orderdate AS date) AS published_at, concat('u', o_custkey % 9) AS sender,
    CASE WHEN o_orderkey % 3 = 0 THEN array('bug', concat('l', o_orderkey % 4)) ELSE array('docs') END AS labels, CASE WHEN o_orderkey % 2 = 0 THEN array(concat('s', o_orderkey % 3)) ELSE array() END AS spaces, CASE o_orderkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'lab' ELSE 'restricted' END AS tier FROM {orders}"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return work.transitions(spark.sql(_ITEMS, orders=read(spark, sf, "orders")))


def item_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Transitions of items, with ids that don't change."""
    return _events(spark, sf).select("id", "repo", "kind", "transition", "moment", "tier")


_SQL_ITEMS = """i AS (SELECT 'org/r' || o_custkey % 6 AS repo, CASE WHEN o_orderkey % 5 = 0 THEN 'release' ELSE 'issue' END AS kind, o_orderkey AS number, o_orderstatus = 'F' AS closed, o_orderkey % 10 = 0 AS draft, o_orderdate::DATE AS moment, 'u' || o_custkey % 9 AS sender,
  CASE WHEN o_orderkey % 3 = 0 THEN ['bug', 'l' || o_orderkey % 4] ELSE ['docs'] END AS labels, CASE WHEN o_orderkey % 2 = 0 THEN ['s' || o_orderkey % 3] ELSE [] END AS spaces, (['public', 'lab', 'restricted'])[o_orderkey % 3 + 1] AS tier FROM orders),
e AS (SELECT repo || ':' || kind || ':' || number || ':' || transition AS id, * FROM (SELECT *, 'published' AS transition FROM i WHERE kind = 'release' AND NOT draft UNION ALL SELECT *, 'opened' FROM i WHERE kind = 'issue' UNION ALL SELECT *, 'closed' FROM i WHERE kind = 'issue' AND closed)),
t AS (SELECT *, unnest(list_distinct(list_concat(['repo:' || repo], list_concat(list_transform(labels, lambda x: 'label:' || x), list_transform(spaces, lambda x: 'space:' || x))))) AS topic FROM e)"""
TRANSITIONS = f"WITH {_SQL_ITEMS} SELECT id, repo, kind, transition, moment, tier FROM e"

_SUBSCRIPTIONS = """SELECT concat('org/r', n_nationkey % 8) AS subscriber, CASE n_nationkey % 4 WHEN 0 THEN concat('repo:org/r', n_nationkey % 6) WHEN 1 THEN concat('label:l', n_nationkey % 4) WHEN 2 THEN concat('space:s', n_nationkey % 3) ELSE 'label:docs' END AS topic,
    CASE WHEN n_nationkey % 5 = 0 THEN array('release') END AS kinds, CASE n_nationkey % 3 WHEN 0 THEN 'lab' WHEN 1 THEN 'restricted' END AS to_tier, n_nationkey % 7 = 0 AS outside FROM {nation}"""


def event_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """What each subscription gets, and what is dropped and why; nothing is delivered to its own repository."""
    return work.deliveries(_events(spark, sf), spark.sql(_SUBSCRIPTIONS, nation=read(spark, sf, "nation")), bot="u3")


_SQL_SUBS = """s AS (SELECT 'org/r' || n_nationkey % 8 AS subscriber, CASE n_nationkey % 4 WHEN 0 THEN 'repo:org/r' || n_nationkey % 6 WHEN 1 THEN 'label:l' || n_nationkey % 4 WHEN 2 THEN 'space:s' || n_nationkey % 3 ELSE 'label:docs' END AS topic, n_nationkey % 5 = 0 AS releases, CASE n_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS to_rank, n_nationkey % 7 = 0 AS outside FROM nation),
d AS (SELECT DISTINCT id, subscriber AS "to", CASE WHEN outside THEN 'outside' WHEN tier = 'restricted' THEN 'restricted is off' WHEN to_rank < CASE tier WHEN 'lab' THEN 1 ELSE 0 END THEN tier || ' -> ' || (['public', 'lab', 'restricted'])[to_rank + 1] END AS reason FROM t JOIN s USING (topic) WHERE sender <> 'u3' AND subscriber <> repo AND (NOT releases OR kind = 'release'))"""
DELIVERIES = f'WITH {_SQL_ITEMS}, {_SQL_SUBS} SELECT id, "to", reason FROM d'


def delivery_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Subscribers with more than twenty deliveries get one digest."""
    return work.digests(event_deliveries(spark, sf))


DIGESTS = f"WITH {_SQL_ITEMS}, {_SQL_SUBS} SELECT \"to\", count(*) AS n, CASE WHEN count(*) > 20 THEN 'digest' ELSE 'single' END AS form FROM d WHERE reason IS NULL GROUP BY 1"


def reader_inbox(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each reader's topics, and which topics they met."""
    follows = read(spark, sf, "nation").selectExpr("n_regionkey AS reader", "CASE n_nationkey % 3 WHEN 0 THEN concat('repo:org/r', n_nationkey % 6) WHEN 1 THEN 'label:bug' ELSE concat('space:s', n_nationkey % 3) END AS topic").distinct()
    return work.inbox(_events(spark, sf), follows)


INBOX = f"WITH {_SQL_ITEMS}, f AS (SELECT DISTINCT n_regionkey AS reader, CASE n_nationkey % 3 WHEN 0 THEN 'repo:org/r' || n_nationkey % 6 WHEN 1 THEN 'label:bug' ELSE 'space:s' || n_nationkey % 3 END AS topic FROM nation) SELECT reader, id, string_agg(DISTINCT topic, ', ' ORDER BY topic) AS topics FROM t JOIN f USING (topic) GROUP BY 1, 2"


def watched_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events before their source was watched are a baseline; sources that aren't watched deliver nothing."""
    sources = read(spark, sf, "region").selectExpr("concat('org/r', r_regionkey) AS repo", "make_date(1994 + r_regionkey, 1, 1) AS watched_from")
    return work.after_baseline(_events(spark, sf), sources).groupBy("repo", "fate").agg(F.count(F.lit(1)).alias("n"))


WATCHED = f"WITH {_SQL_ITEMS} SELECT repo, CASE WHEN right(repo, 1)::INTEGER > 4 THEN 'unwatched' WHEN year(moment) < 1994 + right(repo, 1)::INTEGER THEN 'baseline' ELSE 'deliver' END AS fate, count(*) AS n FROM e GROUP BY 1, 2"


def changed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items that changed since the poll before, and whose marker no trusted writer has left."""
    items = read(spark, sf, "orders").selectExpr("concat('r', o_custkey % 6) AS repo", "o_orderkey AS number", "cast(o_orderdate AS date) AS updated_at", "md5(concat(o_orderstatus, o_orderkey)) AS digest")
    before = read(spark, sf, "orders").where("o_orderkey % 3 > 0").selectExpr("concat('r', o_custkey % 6) AS repo", "o_orderkey AS number", "cast(o_orderdate AS date) AS updated_at", "md5(concat(CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END, o_orderkey)) AS digest")
    sink = read(spark, sf, "orders").selectExpr("o_orderkey AS id", "concat('r', o_custkey % 6) AS to", "CASE o_orderkey % 4 WHEN 0 THEN 'Bus' WHEN 1 THEN 'stranger' ELSE 'none' END AS writer")
    fresh = work.unchanged(items, before).select(F.col("number").alias("id"), F.col("repo").alias("to"))
    return work.undelivered(fresh, sink, ["bus"])


CHANGED = "SELECT o_orderkey AS id, 'r' || o_custkey % 6 AS \"to\" FROM orders WHERE (o_orderkey % 3 = 0 OR o_orderkey % 7 = 0) AND o_orderkey % 4 > 0"


def session_states(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions from their markers in comments: active, waiting for a job that runs, or stale."""
    body = "concat('hi <!-- session id=s', event_id, ' user=u', user_id, ' beat=', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), CASE WHEN event_id % 3 > 0 THEN concat(' job=', event_id % 10) ELSE '' END, CASE WHEN event_id % 4 = 0 THEN concat(' item=o/r#', event_id) ELSE '' END, ' -->')"
    found = read(spark, sf, "events").selectExpr("event_id", f"CASE WHEN event_id % 9 = 0 THEN 'no marker' ELSE {body} END AS body").select("event_id", ln.session(F.col("body")).alias("s")).where("s is not null")
    rows = found.select("event_id", "s.session", "s.user", "s.job", "s.item", "s.beat")
    now = F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    running = read(spark, sf, "region").selectExpr("cast(r_regionkey AS string) AS job")
    return work.session_state(F.col("beat"), F.col("job"), now, 3 * 24 * 60, running, rows).select("event_id", "session", "user", "job", "item", "state")


SESSIONS = """
SELECT event_id, 's' || event_id AS session, 'u' || user_id AS user, CASE WHEN event_id % 3 > 0 THEN (event_id % 10)::VARCHAR END AS job, CASE WHEN event_id % 4 = 0 THEN 'o/r#' || event_id END AS item,
       CASE WHEN TIMESTAMP '2024-01-10' - date_trunc('second', ts) <= INTERVAL 3 DAY THEN 'active' WHEN event_id % 3 > 0 AND event_id % 10 < 5 THEN 'waiting' ELSE 'stale' END AS state FROM events WHERE event_id % 9 > 0
"""


def own_leases(spark: SparkSession, sf: str) -> DataFrame:
    """The newest unexpired lease of each item that its holder posted for themselves."""
    body = "concat('x <!-- lease user=U', o_custkey % 5, ' until=', date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), ' --> y')"
    found = read(spark, sf, "orders").selectExpr("o_custkey AS item", "o_orderkey", f"{body} AS body", "CASE WHEN o_orderkey % 3 > 0 THEN concat('u', o_custkey % 5) ELSE 'forger' END AS author")
    own = found.select("item", "o_orderkey", F.explode(ln.own_leases(F.col("body"), F.col("author"))).alias("x")).select("item", "x.user", F.to_date(F.try_to_timestamp("x.until")).alias("until"))
    return own.where("until > date'1997-01-01'").groupBy("item").agg(F.max(F.struct("until", "user")).alias("x")).select("item", "x.user", "x.until")


LEASES = "SELECT o_custkey AS item, 'U' || o_custkey % 5 AS user, max(o_orderdate::DATE) AS until FROM orders WHERE o_orderkey % 3 > 0 AND o_orderdate::DATE > DATE '1997-01-01' GROUP BY 1, 2"


def lease_takeover(spark: SparkSession, sf: str) -> DataFrame:
    """Which bus is active: the holder, or, of a stale lease, the first ones in order."""
    lease = read(spark, sf, "customer").selectExpr("c_custkey AS lease", "CASE WHEN c_custkey % 6 > 0 THEN concat('b', c_custkey % 5) END AS holder", "CASE WHEN c_custkey % 11 > 0 THEN c_custkey % 70 END AS age", "15 AS life")
    buses = read(spark, sf, "customer").selectExpr("c_custkey AS lease", "explode(array(named_struct('bus', 'b0', 'place', 0), named_struct('bus', 'b1', 'place', 1), named_struct('bus', 'b2', 'place', 2))) AS x").select("lease", "x.bus", "x.place")
    return work.takeover(lease, buses)


TAKEOVER = """
WITH b AS (SELECT c_custkey AS lease, unnest([0, 1, 2]) AS place, CASE WHEN c_custkey % 6 > 0 THEN c_custkey % 5 END AS holder, CASE WHEN c_custkey % 11 > 0 THEN c_custkey % 70 END AS age FROM customer),
r AS (SELECT *, place - CASE WHEN holder < place THEN 1 ELSE 0 END AS k FROM b)
SELECT lease, 'b' || place AS bus, CASE WHEN holder IS NULL OR holder = place THEN 'active' WHEN age <= 15 THEN 'passive' WHEN age IS NULL OR age - 15 >= k * 15 THEN 'active' ELSE 'passive' END AS decision FROM r
"""


def redacted_governed(spark: SparkSession, sf: str) -> DataFrame:
    """Restricted keys hashed, and verdicts that block when they are missing or malformed."""
    rows = read(spark, sf, "customer").selectExpr("c_custkey AS id", "concat(' ', c_name) AS key", "CASE WHEN c_custkey % 3 = 0 THEN 'restricted' ELSE 'lab' END AS tier")
    verdicts = read(spark, sf, "customer").where("c_custkey % 4 > 0").selectExpr("c_custkey AS id", "CASE c_custkey % 4 WHEN 1 THEN 'allow' WHEN 2 THEN 'warn' ELSE 'maybe' END AS decision")
    return work.governed(work.redacted(rows, "key"), verdicts).select("id", "key", "decision")


GOVERNED = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN sha256(lower(c_name)) ELSE ' ' || c_name END AS key, CASE c_custkey % 4 WHEN 1 THEN 'allow' WHEN 2 THEN 'warn' ELSE 'block' END AS decision FROM customer"


def next_work(spark: SparkSession, sf: str) -> DataFrame:
    """Ready items without a blocker or another's lease, by context; the list has 25 items."""
    items = read(spark, sf, "orders").selectExpr("o_orderkey AS item", "o_orderkey AS place", "CASE WHEN o_orderkey % 9 > 0 THEN 'Issue' ELSE 'Draft' END AS type", "CASE WHEN o_orderstatus = 'O' THEN 'Ready' ELSE 'Done' END AS Status", "CASE o_orderkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' END AS `Agent-ready`", "array(concat('u', o_custkey % 12)) AS owners")
    blocked = read(spark, sf, "orders").where("o_custkey % 7 = 0").selectExpr("o_orderkey AS item")
    leases = read(spark, sf, "orders").where("o_custkey % 5 = 0").selectExpr("o_orderkey AS item", "concat('U', o_orderkey % 2) AS user")
    contexts = [("personal", F.coalesce("mine", F.lit(False)) | F.array_contains("owners", "u1")), ("group", F.arrays_overlap("owners", F.array(F.lit("u2"), F.lit("u3"), F.lit("u4"))))]
    return work.next_work(work.candidates(items), blocked, leases, "u1", contexts, 25).select("item", "context")


NEXT = """
SELECT item, context FROM (SELECT o_orderkey AS item, CASE WHEN (o_custkey % 5 = 0 AND o_orderkey % 2 = 1) OR o_custkey % 12 = 1 THEN 'personal' WHEN o_custkey % 12 IN (2, 3, 4) THEN 'group' END AS context FROM orders
WHERE o_orderkey % 9 > 0 AND o_orderstatus = 'O' AND o_orderkey % 3 = 0 AND o_custkey % 7 > 0 AND NOT (o_custkey % 5 = 0 AND o_orderkey % 2 = 0)) WHERE context IS NOT NULL ORDER BY context DESC, item LIMIT 25
"""


def item_involvement(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of contribution of each member to an item, as text."""
    orders = read(spark, sf, "orders")
    items = orders.selectExpr("o_orderkey AS item", "concat('U', o_custkey % 6) AS author", "o_orderkey % 3 = 0 AS is_pull", "array(CASE WHEN o_orderkey % 2 = 0 THEN 'kind: bug' ELSE 'debug' END) AS labels")
    items = items.select("item", "author", "is_pull", work.is_bug(F.col("labels"), F.lit(None).cast("string")).alias("is_bug"))
    comments = orders.where("o_orderkey % 4 = 0").selectExpr("o_orderkey AS item", "concat('u', o_orderkey % 9) AS login")
    reviews = orders.where("o_orderkey % 5 = 0").selectExpr("o_orderkey AS item", "concat('u', o_orderkey % 6) AS login")
    named = orders.selectExpr("o_orderkey AS item", "concat('u', o_orderkey % 7) AS login", "CASE o_orderkey % 3 WHEN 1 THEN concat('Fixes: o/r#', o_orderkey) ELSE concat('prefixes #', o_orderkey, ' and resolves #', o_orderkey + 1) END AS text")
    references = named.select("item", "login", work.closes(F.col("text"), F.lit("o/r"), F.col("item"), F.lit(True)).alias("closes"))
    members = spark.range(5).selectExpr("concat('u', id) AS login")
    found = work.involvement(items, comments, reviews, references, members)
    return found.groupBy("item").agg(ln.contribution_text(F.collect_list(F.struct("login", "kinds"))).alias("contributions"))


INVOLVEMENT = """
WITH k AS (SELECT o_orderkey AS item, 'u' || o_custkey % 6 AS login, CASE WHEN o_orderkey % 3 = 0 THEN 'fix' WHEN o_orderkey % 2 = 0 THEN 'report' ELSE 'request' END AS kind FROM orders
UNION SELECT o_orderkey, 'u' || o_orderkey % 9, 'comment' FROM orders WHERE o_orderkey % 4 = 0 UNION SELECT o_orderkey, 'u' || o_orderkey % 6, 'review' FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 AND o_orderkey % 6 <> o_custkey % 6
UNION SELECT o_orderkey, 'u' || o_orderkey % 7, CASE WHEN o_orderkey % 3 = 1 THEN 'fix' ELSE 'mention' END FROM orders WHERE o_orderkey % 3 > 0),
g AS (SELECT item, login, string_agg(kind, ', ' ORDER BY list_position(['report', 'request', 'fix', 'review', 'comment', 'mention'], kind)) AS kinds FROM k WHERE right(login, 1)::INTEGER < 5 AND length(login) = 2 GROUP BY 1, 2)
SELECT item, string_agg(login || ': ' || kinds, '; ' ORDER BY login) AS contributions FROM g GROUP BY 1
"""


def contribution_credits(spark: SparkSession, sf: str) -> DataFrame:
    """Contributions by person and kind, from their texts."""
    text = "concat('@Ann', o_custkey % 4, ': fix, odd, review; ; bob: ', CASE WHEN o_orderkey % 2 = 0 THEN 'comment' ELSE 'mention,fix' END)"
    found = read(spark, sf, "orders").selectExpr(f"{text} AS text").select(F.explode(ln.contributions(F.col("text"))).alias("x")).select("x.login", F.explode("x.kinds").alias("kind"))
    return found.groupBy("login", "kind").agg(F.count(F.lit(1)).alias("n"))


CREDITS = "SELECT login, kind, count(*) AS n FROM (SELECT 'ann' || o_custkey % 4 AS login, unnest(['fix', 'review']) AS kind FROM orders UNION ALL SELECT 'bob', 'comment' FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'bob', unnest(['mention', 'fix']) FROM orders WHERE o_orderkey % 2 = 1) GROUP BY 1, 2"


def body_links(spark: SparkSession, sf: str) -> DataFrame:
    """Link lines of items: edges, lines that can't be read, and edges that their type may not have."""
    body = "concat('text\\n```links\\n# note\\n', CASE o_orderkey % 3 WHEN 0 THEN 'tests: o/r#' WHEN 1 THEN 'produces: kg:' ELSE 'Bad line ' END, o_orderkey, '\\n\\ncites: o/r#7\\n```\\nmore: o/r#8')"
    rows = read(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN 'question' ELSE 'dataset' END AS type", f"{body} AS body")
    found = rows.select("o_orderkey", "type", F.explode(ln.links(F.col("body"))).alias("x")).select("o_orderkey", "type", "x.*")
    allowed = spark.createDataFrame([("question", "tests"), ("dataset", "produces"), ("question", "cites"), ("dataset", "cites")], "type string, edge string")
    bad = found.join(allowed.withColumn("ok", F.lit(True)), ["type", "edge"], "left")
    problem = F.when(F.col("edge").isNull(), F.concat(F.lit("cannot parse "), "line")).when(F.col("ok").isNull(), F.concat("type", F.lit(" cannot "), "edge"))
    return bad.select("o_orderkey", "edge", "target", problem.alias("problem"))


LINKS = """
WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'question' ELSE 'dataset' END AS type, CASE o_orderkey % 3 WHEN 0 THEN 'tests' WHEN 1 THEN 'produces' END AS edge, CASE o_orderkey % 3 WHEN 0 THEN 'o/r#' || o_orderkey WHEN 1 THEN 'kg:' || o_orderkey END AS target FROM orders UNION ALL SELECT o_orderkey, 'x', 'cites', 'o/r#7' FROM orders)
SELECT o_orderkey, edge, target, CASE WHEN edge IS NULL THEN 'cannot parse Bad line ' || o_orderkey WHEN edge = 'tests' AND type <> 'question' THEN 'dataset cannot tests' WHEN edge = 'produces' AND type <> 'dataset' THEN 'question cannot produces' END AS problem FROM l
"""


def form_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of issue forms, and tokens of a budget line."""
    body = "concat('### Name\\n\\n', c_name, '\\n\\n### Segment (one)\\n\\n', CASE WHEN c_custkey % 3 = 0 THEN '_No response_' ELSE c_mktsegment END, '\\n\\n### Budget\\n\\niters=', c_custkey, ', hours: ', c_nationkey, ' iters=9')"
    fields = read(spark, sf, "customer").selectExpr("c_custkey", f"{body} AS body").select("c_custkey", ln.form(F.col("body")).alias("m"))
    tokens = ln.tokens_of(F.col("m")["budget"], ["iters", "hours", "gpus"])
    return fields.select("c_custkey", F.col("m")["name"].alias("name"), F.col("m")["segment (one)"].alias("segment"), tokens["iters"].alias("iters"), tokens["hours"].alias("hours"), F.map_contains_key(tokens, "gpus").alias("has_gpus"))


FORMS = "SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment, c_custkey::VARCHAR AS iters, c_nationkey::VARCHAR AS hours, false AS has_gpus FROM customer"


def quoted_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles quoted within a length, and as cells of a table."""
    rows = read(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_size % 3 = 0 THEN concat('a \"', p_name, '\" b') WHEN p_size % 3 = 1 THEN concat(p_name, '|', p_brand) ELSE p_brand END AS title")
    return rows.select("p_partkey", work.quoted_within(F.col("title"), 16).alias("quoted"), ln.markdown_row(F.col("p_partkey"), F.col("title"), width=12).alias("row"))


QUOTED = r"""
WITH t AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'a "' || p_name || '" b' WHEN 1 THEN p_name || '|' || p_brand ELSE p_brand END AS title FROM part),
q AS (SELECT *, '"' || replace(title, '"', '\"') || '"' AS whole, replace(title, '|', '\|') AS cell FROM t),
c AS (SELECT p_partkey, max(n) AS n FROM q, range(1, 17) r(n) WHERE length('"' || replace(left(title, n) || '...', '"', '\"') || '"') <= 16 GROUP BY 1)
SELECT q.p_partkey, CASE WHEN length(whole) <= 16 THEN whole ELSE '"' || replace(left(title, n) || '...', '"', '\"') || '"' END AS quoted, '| ' || q.p_partkey || ' | ' || CASE WHEN length(cell) > 12 THEN left(cell, 11) || '…' ELSE cell END || ' |' AS row FROM q LEFT JOIN c USING (p_partkey)
"""

QUERIES = {
    "item_tiers": (item_tiers, TIERS),
    "combined_tiers": (combined_tiers, COMBINED),
    "item_transitions": (item_transitions, TRANSITIONS),
    "event_deliveries": (event_deliveries, DELIVERIES),
    "delivery_digests": (delivery_digests, DIGESTS),
    "reader_inbox": (reader_inbox, INBOX),
    "watched_events": (watched_events, WATCHED),
    "changed_items": (changed_items, CHANGED),
    "session_states": (session_states, SESSIONS),
    "own_leases": (own_leases, LEASES),
    "lease_takeover": (lease_takeover, TAKEOVER),
    "redacted_governed": (redacted_governed, GOVERNED),
    "next_work": (next_work, NEXT),
    "item_involvement": (item_involvement, INVOLVEMENT),
    "contribution_credits": (contribution_credits, CREDITS),
    "body_links": (body_links, LINKS),
    "form_fields": (form_fields, FORMS),
    "quoted_titles": (quoted_titles, QUOTED),
}
