"""Cluster inventory: health and fit of nodes, free devices, mounts, entitlements, reservations, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.sources import lines as ln

# States and flags of nodes that can't be used, and words of a reason that concern devices.
BAD_STATES = ["DRAIN", "DOWN", "FAIL", "MAINT", "NOT_RESPONDING", "INVAL"]
NOT_NOW = ["POWER", "RESERVED"]
LIVE = ["IDLE", "MIXED", "ALLOC"]
FLAGS = r"[*~#%$@^!-]"
GPU_REASON = r"(?i)gpu|gres|nvidia|nvml|xid|ecc|cuda"


def unhealthy(node: Column) -> Column:
    """Why a node must not be used; empty if it looks healthy."""
    state, cfg = F.upper(node["state"]), F.try_element_at(node["cfg"], F.lit("gres/gpu"))
    gres, used = ln.gpu_total(node["gres"]), ln.gpu_total(node["gres_used"])
    bad = F.lit(False)
    for word in BAD_STATES:
        bad |= state.contains(word)
    live = F.lit(False)
    for word in LIVE:
        live |= state.startswith(word)
    why = F.when(node["reason"] != "", F.concat(F.lit(" ("), node["reason"], F.lit(")"))).otherwise("")
    return (
        F.when(bad, F.concat(F.lit("state "), node["state"], why))
        .when(~live, F.concat(F.lit("state "), F.coalesce(F.nullif(node["state"], F.lit("")), F.lit("unknown"))))
        .when(gres != cfg, F.format_string("GRES mismatch: Gres reports %d gpu, CfgTRES %d", gres, cfg))
        .when(used > gres, F.format_string("GRES mismatch: GresUsed %d gpu exceeds Gres %d", used, gres))
        .when(gres.isNull() & (cfg > 0), F.format_string("GRES mismatch: CfgTRES %d gpu but no Gres gpu entry", cfg))
        .when((node["reason"] != "") & node["reason"].rlike(GPU_REASON), F.concat(F.lit("reason: "), node["reason"]))
        .otherwise("")
    )


def fits(node: Column, cpus: Column, memory: Column, devices: Column, device: Column) -> Column:
    """Whether a healthy node has the processors, megabytes and devices idle now."""
    state = F.upper(node["state"])
    have = lambda m, k: F.coalesce(F.try_element_at(node[m], k), F.lit(0))
    free = lambda k: have("cfg", k) - have("alloc", k)
    key = F.when(device != "", F.concat(F.lit("gres/gpu:"), device)).otherwise("gres/gpu")
    now = state.startswith("IDLE") | state.startswith("MIXED")
    for word in NOT_NOW:
        now &= ~state.contains(word)
    has_memory = (have("cfg", F.lit("mem")) == 0) | (memory == 0) | (free(F.lit("mem")) >= memory)
    has_devices = (devices == 0) | (F.map_contains_key(node["cfg"], key) & (free(key) >= devices))
    return (unhealthy(node) == "") & now & (free(F.lit("cpu")) >= cpus) & has_memory & has_devices


def free_devices(rows: DataFrame) -> DataFrame:
    """(partition, type, free) of lines (partition, state, gres, used): configured less used, on nodes that take work."""
    usable = rows.where(F.col("state").rlike("idle|mixed|allocated") & ~F.col("state").rlike(FLAGS))
    usable = usable.withColumn("partition", F.regexp_replace("partition", r"\*+$", "")).where("partition != ''")
    total = lambda entries, kind: F.aggregate(F.filter(entries, lambda x: x["type"] == kind), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    conf, used = ln.gpus(F.col("gres")), ln.gpus(F.col("used"))
    kinds = F.array_distinct(F.transform(conf, lambda x: x["type"]))
    each = F.transform(kinds, lambda k: F.struct(k.alias("type"), F.greatest(F.lit(0), total(conf, k) - total(used, k)).alias("free")))
    spread = usable.select("partition", F.explode(each).alias("x")).where("x.free > 0")
    return spread.groupBy("partition", F.col("x.type").alias("type")).agg(F.sum("x.free").alias("free"))


def mount_tier(source: Column, path: Column, servers: list[tuple[str, str]], paths: list[tuple[str, str]]) -> Column:
    """Tier by the server's name, else by the path, else ``other``; rules are (pattern, tier), first match wins."""
    server = F.substring_index(F.substring_index(F.coalesce(source, F.lit("")), ":", 1), ".", 1)
    found = F.lit(None).cast("string")
    for pattern, tier in reversed(paths):
        found = F.when(path.rlike(f"^(?:{pattern})"), tier).otherwise(found)
    by_path, found = found, F.lit(None).cast("string")
    for pattern, tier in reversed(servers):
        found = F.when((server != "") & server.rlike(f"^(?:{pattern})"), tier).otherwise(found)
    return F.coalesce(found, by_path, F.lit("other"))


def entitlements(projects: DataFrame, held: DataFrame) -> DataFrame:
    """Every (user, project) with whether the user is in any of its groups; projects are a stated list."""
    member = F.arrays_overlap("groups", "held")
    return held.join(F.broadcast(projects)).select("user", "project", F.coalesce(member, F.lit(False)).alias("granted"))


def conflicts(jobs: DataFrame, reservations: DataFrame) -> DataFrame:
    """The first reservation that begins within a job's walltime and covers its partition, or all of them.

    jobs: (job, partition, now, seconds); reservations: (reservation, starts, partition, flags). Both sides are dealt out
    by day, so that the range is an equality and a bound; ``fits`` is the longest walltime that still ends in time.
    """
    day = lambda c: F.floor(F.unix_seconds(c) / 86400)
    deadline = F.timestamp_seconds(F.unix_seconds("now") + F.col("seconds"))
    open_jobs = jobs.where("seconds > 0").select("job", F.col("partition").alias("own"), "now", deadline.alias("deadline"), F.explode(F.sequence(day(F.col("now")), day(deadline))).alias("day"))
    wide = F.upper("flags").rlike("MAINT|ALL_NODES")
    marked = reservations.select("reservation", "starts", F.col("partition").alias("covers"), wide.alias("wide"), day(F.col("starts")).alias("day"))
    met = open_jobs.join(marked, "day").where("starts > now and starts <= deadline and (wide or covers = own)")
    first = met.groupBy("job").agg(F.min(F.struct("starts", "reservation", (F.unix_seconds("starts") - F.unix_seconds("now")).alias("fits"))).alias("x"))
    return first.select("job", "x.reservation", "x.fits")


def problems(rows: DataFrame) -> Column:
    """What is wrong with a job's allocation of (job, alloc, visible, listed), an array of texts; empty if nothing is."""
    listed = F.size("listed")
    return F.array_compact(
        F.array(
            F.when(F.coalesce("job", F.lit("")) == "", F.lit("not inside a job")),
            F.when(F.col("alloc").isNull(), F.lit("no allocation")),
            F.when(F.col("listed").isNotNull() & (listed != F.col("alloc")), F.format_string("%d listed, %d allocated", listed, F.col("alloc"))),
            F.when(F.col("listed").isNull() & (F.col("alloc") > 0), F.format_string("none listed, %d allocated", F.col("alloc"))),
            F.when(F.col("visible") != F.col("alloc"), F.format_string("%d visible, %d allocated", F.col("visible"), F.col("alloc"))),
        )
    )


def _scaled(text: Column) -> Column:
    number = F.regexp_extract(text, r"^\s*([\d.]+)\s*[KMGTBP]?\s*$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^\s*[\d.]+\s*([KMGTBP]?)\s*$", 1)
    power = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit.isin("B", "G"), 1e9).when(unit == "T", 1e12).when(unit == "P", 1e15).otherwise(1.0)
    return number * power


def same_value(a: Column, b: Column) -> Column:
    """Equal texts, or rendered numbers less than a hundredth apart; whole numbers must be equal, zero only equals zero."""
    x, y = _scaled(a), _scaled(b)
    whole = F.trim(a).rlike(r"^\d+$") & F.trim(b).rlike(r"^\d+$")
    close = F.when((x == 0) | (y == 0), x == y).otherwise(F.try_divide(F.abs(x - y), F.greatest(F.abs(x), F.abs(y))) < 0.01)
    return F.coalesce((a == b) | (~whole & close), F.lit(False))


def snapshot_changes(old: DataFrame, new: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """(path, before, after, change) of two tables (path, value), but for ignored paths; same values don't show."""
    both = old.select("path", F.col("value").alias("before")).join(new.select("path", F.col("value").alias("after")), "path", "full")
    for pattern in ignored or []:
        both = both.where(~F.col("path").rlike(pattern))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~same_value(F.col("before"), F.col("after")), "changed")
    return both.withColumn("change", change).where("change is not null")
