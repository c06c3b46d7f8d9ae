"""Work items and events: tiers, transitions, routing, inboxes, leases, sessions, candidates, contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.sources.lines import KINDS

# Tiers from the loosest to the strictest.
TIERS = ["public", "lab", "restricted"]


def rank(tier: Column) -> Column:
    """0, 1 or 2; null for an unknown tier."""
    place = F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier)
    return F.when(place > 0, place - 1)


def tier_name(place: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in TIERS]), place.cast("int"))


def strictest(*tiers: Column) -> Column:
    """The strictest of the known tiers; public if none is."""
    return tier_name(F.greatest(F.lit(0), *[F.coalesce(rank(t), F.lit(0)) for t in tiers]))


def tier_of(visibility: Column, labels: Column, declared: Column, external: Column, opt_in: Column) -> Column:
    """An item's tier, from its repository's visibility, a declared tier and ``tier:`` labels, which only tighten.

    Unknown visibility is restricted, and so is what is not public outside the home organisation, unless opted in.
    """
    known = F.coalesce(visibility.isin("public", "private", "internal"), F.lit(False))
    base = F.when(visibility == "public", 0).otherwise(1)
    marked = F.transform(F.filter(labels, lambda x: x.startswith("tier:")), lambda x: F.coalesce(rank(F.substring_index(x, ":", -1)), F.lit(0)))
    strict = F.greatest(base, F.coalesce(rank(declared), F.lit(0)), F.coalesce(F.array_max(marked), F.lit(0)))
    return tier_name(F.when(~known | (external & (visibility != "public") & ~opt_in), 2).otherwise(strict))


def destination_tier(visibility: Column, override: Column, declared: Column) -> Column:
    """Where a delivery lands; unknown visibility counts as public, so that nothing stricter goes there."""
    actual = F.when(visibility.isin("private", "internal"), "lab").otherwise("public")
    return strictest(actual, override, declared)


def may_deliver(event: Column, to: Column) -> Column:
    """Events go to equal or stricter tiers only."""
    return rank(to) >= rank(event)


def combined_tier(items: DataFrame, key: str, tier: str = "tier") -> DataFrame:
    """The tier of what combines items: the strictest, an unknown one counting as restricted."""
    return items.groupBy(key).agg(tier_name(F.max(F.coalesce(rank(F.col(tier)), F.lit(2)))).alias("tier"))


def transitions(items: DataFrame) -> DataFrame:
    """One row for each transition that an item has reached, with an id that is the same at every poll.

    items: (repo, kind, number, state, draft, created_at, closed_at, published_at, ...).
    """
    step = lambda name, at: F.struct(F.lit(name).alias("transition"), F.col(at).alias("moment"))
    release = F.when(~F.col("draft"), F.array(step("published", "published_at")))
    other = F.when(F.col("state") == "closed", F.array(step("opened", "created_at"), step("closed", "closed_at"))).otherwise(F.array(step("opened", "created_at")))
    found = items.select("*", F.explode(F.when(F.col("kind") == "release", release).otherwise(other)).alias("x"))
    identity = F.concat_ws(":", "repo", "kind", F.col("number").cast("string"), "x.transition")
    return found.select(identity.alias("id"), *items.columns, "x.transition", "x.moment").drop("state", "draft", "created_at", "closed_at", "published_at")


def topics(events: DataFrame) -> DataFrame:
    """An event's topics, one row each: its repository, its labels, its spaces."""
    own = F.array(F.concat(F.lit("repo:"), "repo"))
    marked = F.transform("labels", lambda x: F.concat(F.lit("label:"), x))
    placed = F.transform("spaces", lambda x: F.concat(F.lit("space:"), x))
    return events.withColumn("topic", F.explode(F.array_distinct(F.concat(own, marked, placed))))


def deliveries(events: DataFrame, subscriptions: DataFrame, bot: str, restricted_ok: bool = False) -> DataFrame:
    """(id, to, reason) for every subscription that an event meets; a null reason is a delivery, else a drop.

    subscriptions: (subscriber, topic, kinds, to_tier, outside); kinds null takes all. Topics are equalities, so the join
    is one by topic; what a bot sent and what a repository would tell itself is left out.
    """
    met = topics(events.where(F.coalesce("sender", F.lit("")) != bot)).join(subscriptions, "topic").where("kinds is null or array_contains(kinds, kind)").where("subscriber != repo")
    to = F.coalesce("to_tier", F.lit("public"))
    reason = (
        F.when(F.col("outside"), F.lit("outside"))
        .when((F.col("tier") == "restricted") & F.lit(not restricted_ok), F.lit("restricted is off"))
        .when(~may_deliver(F.col("tier"), to), F.concat("tier", F.lit(" -> "), to))
    )
    return met.select("id", F.col("subscriber").alias("to"), reason.alias("reason")).distinct()


def digests(found: DataFrame, most: int = 20) -> DataFrame:
    """(to, n, form): subscribers with more deliveries than ``most`` get one digest, others each delivery."""
    return found.where("reason is null").groupBy("to").agg(F.count(F.lit(1)).alias("n")).withColumn("form", F.when(F.col("n") > most, "digest").otherwise("single"))


def inbox(events: DataFrame, follows: DataFrame) -> DataFrame:
    """Events of each reader's topics, with the topics that they met."""
    met = topics(events).join(follows, "topic")
    return met.groupBy("reader", "id").agg(F.array_join(F.array_sort(F.collect_set("topic")), ", ").alias("topics"))


def after_baseline(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Events since their source was first watched; earlier ones are recorded as ``baseline``, not delivered."""
    found = events.join(sources.select("repo", "watched_from"), "repo", "left")
    return found.withColumn("fate", F.when(F.col("watched_from").isNull(), "unwatched").when(F.col("moment") < F.col("watched_from"), "baseline").otherwise("deliver")).drop("watched_from")


def unchanged(items: DataFrame, remembered: DataFrame) -> DataFrame:
    """T5: items whose time and digest are not those remembered from the poll before."""
    return items.join(remembered.select("repo", "number", "updated_at", "digest"), ["repo", "number", "updated_at", "digest"], "left_anti")


def undelivered(found: DataFrame, sink: DataFrame, writers: list[str]) -> DataFrame:
    """Deliveries without a marker of their id in the sink by a trusted writer; markers of others don't count."""
    trusted = sink.where(F.lower("writer").isin(*[w.lower() for w in writers])).select("id", "to")
    return found.join(trusted, ["id", "to"], "left_anti")


def session_state(beat: Column, job: Column, now: Column, stale_minutes: int, running: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with ``state``: active, waiting while its job still runs, or stale."""
    joined = rows.join(running.select(F.col("job").alias("_running")).distinct(), job == F.col("_running"), "left")
    fresh = F.unix_seconds(now) - F.unix_seconds(beat) <= stale_minutes * 60
    return joined.withColumn("state", F.when(fresh, "active").when(F.col("_running").isNotNull(), "waiting").otherwise("stale")).drop("_running")


def takeover(lease: DataFrame, buses: DataFrame) -> DataFrame:
    """(bus, decision) for each bus of a lease (holder, age, life in minutes): who holds it, waits, or takes over.

    A stale lease is taken over in order, the holder left out: the k-th bus once the lease has been stale for k more
    periods. A null age is of a lease whose date can't be read, and is stale for ever.
    """
    holder = lease.select("lease", "holder", "age", "life")
    joined = buses.join(holder, "lease", "left")
    # A bus's place among those that don't hold the lease, in their order.
    mine = F.array_position(F.transform(F.array_sort(F.filter("queue", lambda x: x["bus"] != F.col("holder"))), lambda x: x["bus"]), F.col("bus")) - 1
    queue = buses.groupBy("lease").agg(F.array_sort(F.collect_list(F.struct("place", "bus"))).alias("queue"))
    ranked = joined.join(queue, "lease")
    late = F.col("age").isNull() | (F.col("age") - F.col("life") >= mine * F.col("life"))
    decision = F.when(F.col("holder").isNull(), "active").when(F.col("bus") == F.col("holder"), "active").when(F.col("age") <= F.col("life"), "passive").when(late, "active").otherwise("passive")
    return ranked.select("lease", "bus", decision.alias("decision"))


def redacted(rows: DataFrame, key: str, tier: str = "tier") -> DataFrame:
    """Keys of restricted rows as hashes of their trimmed lower-case form; others as they are."""
    return rows.withColumn(key, F.when(F.col(tier) == "restricted", F.sha2(F.lower(F.trim(key)), 256)).otherwise(F.col(key)))


def governed(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows with their verdict's decision; a missing or malformed one blocks."""
    sound = verdicts.where(F.col("decision").isin("allow", "warn", "block"))
    return rows.join(sound.groupBy("id").agg(F.max("decision").alias("decision")), "id", "left").withColumn("decision", F.coalesce("decision", F.lit("block")))


def candidates(items: DataFrame) -> DataFrame:
    """Issues that are ready and meant for agents; field names are matched whatever their case and signs."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    named = {"".join(ch for ch in c.lower() if ch.isalnum()): c for c in reversed(items.columns)}
    return items.where((F.col("type") == "Issue") & (F.coalesce(F.col(f"`{named['status']}`"), F.lit("")) == "Ready") & (plain(F.coalesce(F.col(f"`{named['agentready']}`"), F.lit(""))) == "yes"))


def next_work(items: DataFrame, blocked: DataFrame, leases: DataFrame, me: str, contexts: list[tuple[str, Column]], limit: int) -> DataFrame:
    """Items without an open blocker or another's lease, by the first context that they match, then their order.

    items: (item, place, ...); leases: (item, user), live ones. ``limit`` is the length of the list that is asked for.
    """
    others = leases.where(F.lower("user") != me.lower()).select("item")
    kept = items.join(blocked.select("item"), "item", "left_anti").join(others, "item", "left_anti").join(leases.where(F.lower("user") == me.lower()).select("item", F.lit(True).alias("mine")).distinct(), "item", "left")
    place, name = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k, (label, match) in reversed(list(enumerate(contexts))):
        place, name = F.when(match, k).otherwise(place), F.when(match, label).otherwise(name)
    ranked = kept.withColumn("_k", place).withColumn("context", name).where("_k is not null")
    return ranked.orderBy("_k", "place").limit(limit).drop("_k", "mine")


def kinds_of_item(author: Column, is_pull: Column, is_bug: Column) -> Column:
    return F.when(is_pull, "fix").when(is_bug, "report").otherwise("request")


def involvement(items: DataFrame, comments: DataFrame, reviews: DataFrame, references: DataFrame, members: DataFrame) -> DataFrame:
    """(item, login, kinds) of members: who opened it, commented, reviewed another's change, fixed or mentioned it.

    items: (item, author, is_pull, is_bug); references: (item, login, closes), of changes that name an issue.
    """
    opened = items.select("item", F.lower("author").alias("login"), kinds_of_item(F.col("author"), F.col("is_pull"), F.col("is_bug")).alias("kind"))
    said = comments.select("item", F.lower("login").alias("login"), F.lit("comment").alias("kind"))
    judged = reviews.join(items.where("is_pull").select("item", "author"), "item").where("lower(login) != lower(author)").select("item", F.lower("login").alias("login"), F.lit("review").alias("kind"))
    linked = references.join(items.where("not is_pull").select("item"), "item").select("item", F.lower("login").alias("login"), F.when(F.col("closes"), "fix").otherwise("mention").alias("kind"))
    every = opened.unionByName(said).unionByName(judged).unionByName(linked).join(members.select(F.lower("login").alias("login")).distinct(), "login", "left_semi").distinct()
    order = F.array(*[F.lit(k) for k in KINDS])
    held = every.groupBy("item", "login").agg(F.collect_set("kind").alias("found"))
    return held.select("item", "login", F.filter(order, lambda k: F.array_contains("found", k)).alias("kinds"))


CLOSING = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s*:?\s+"


def closes(text: Column, repo: Column, number: Column, same: Column) -> Column:
    """whether a text closes an issue by keyword: ``#n`` in the same repository, ``owner/repo#n`` or its link."""
    named = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CLOSING + r"((?:https?://[^\s/]+/)?[\w.-]+/[\w.-]+(?:#|/issues/)\d+|#\d+)\b"), F.lit(1))
    target = F.concat(repo, F.lit("#"), number.cast("string"))
    plain = lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"^https?://[^\s/]+/", ""), "/issues/", "#"))
    return F.exists(named, lambda x: (plain(x) == F.lower(target)) | (same & (x == F.concat(F.lit("#"), number.cast("string")))))


def is_bug(labels: Column, kind: Column) -> Column:
    """whether a label or the type names a bug."""
    return F.exists(labels, lambda x: x.rlike(r"(?i)\bbug\b")) | F.coalesce(kind.rlike(r"(?i)\bbug\b"), F.lit(False))


def quoted_within(text: Column, room: int) -> Column:
    """a text as a JSON string of at most ``room`` characters, cut before it is quoted so that it stays closed."""
    quote = lambda t: F.concat(F.lit('"'), F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    whole = quote(text)
    # The longest start that still fits with its dots: quoting only lengthens, so lengths are tried downwards.
    cuts = F.transform(F.sequence(F.lit(room), F.lit(1), F.lit(-1)), lambda n: quote(F.concat(F.substring(text, F.lit(1), n), F.lit("..."))))
    short = F.element_at(F.filter(cuts, lambda c: F.length(c) <= room), 1)
    return F.when(F.length(whole) <= room, whole).otherwise(F.coalesce(short, F.lit('""')))
