"""Append-only corrections: revisions, relabelling, filling, overriding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.shared import written


def current(rows: DataFrame, id_col: str, supersedes: str) -> DataFrame:
    """Rows that no other row supersedes."""
    gone = rows.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(id_col))
    return rows.join(gone, id_col, "left_anti")


def relabelled(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``rows`` with the values of a foreign key renamed by (old, new); others stay."""
    joined = rows.join(names.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col(column) == F.col("_old"), "left")
    return joined.withColumn(column, F.coalesce("_new", column)).select(*rows.columns)


def resolved_keys(names: DataFrame, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """K3: ((old, new), (key, problem)): chains of renamings followed to their ends by pointer jumping.

    names: (old, new) in any order. Each round a key's name is replaced by its name's name, so a chain's length halves. An
    old key with several new ones is a ``clash`` and takes none; a key that comes round to itself is a ``cycle`` and keeps
    its name, as does what leads to it. Renamings to oneself say nothing; null ones don't count.
    """
    told = names.select("old", "new").where("old is not null and new is not null and old != new").distinct()
    counts = told.groupBy("old").agg(F.min("new").alias("new"), F.count(F.lit(1)).alias("n"))
    clashes = counts.where("n > 1").select(F.col("old").alias("key"), F.lit("clash").alias("problem"))
    now = written(counts.where("n = 1").select("old", "new"), "renamed")
    cyclic = now.limit(0).select(F.col("old").alias("key"))
    for _ in range(most):
        ahead = now.join(now.select(F.col("old").alias("new"), F.col("new").alias("_next")), "new", "left")
        then = written(ahead.select("old", F.coalesce("_next", "new").alias("new"), F.col("_next").isNotNull().alias("moved")), "renamed")
        round_trip = then.where("old = new").select(F.col("old").alias("key"))
        if not then.where("moved").isEmpty() and not round_trip.isEmpty():
            cyclic = written(cyclic.unionByName(round_trip).distinct(), "cycles")
        # What stands on a cycle, or leads to one, is taken out and keeps its name.
        now = written(then.select("old", "new").join(cyclic.select(F.col("key").alias("old")), "old", "left_anti").join(cyclic.select(F.col("key").alias("new")), "new", "left_anti"), "renamed")
        if now.join(now.select(F.col("old").alias("new")), "new", "left_semi").isEmpty():
            return now, clashes.unionByName(cyclic.select("key", F.lit("cycle").alias("problem")))
    raise RuntimeError("renamings did not settle")


def rekeyed(tables: dict[str, tuple[DataFrame, list[str]]], names: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """K3: (tables with every foreign key renamed, (key, problem)): ``tables`` maps a name to (rows, key columns)."""
    new, problems = resolved_keys(names)
    out = {}
    for name, (rows, columns) in tables.items():
        for column in columns:
            rows = relabelled(rows, column, new)
        out[name] = rows
    return out, problems


def set_algebra(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """U4: (key, shared, only_left, only_right): values of two tables by key, in order; a key of one table only has its values there."""
    gathered = lambda rows, name: rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.collect_set(value).alias(name))
    both = gathered(left, "_l").join(gathered(right, "_r"), key, "full")
    none = F.array().cast(both.schema["_l"].dataType)
    l, r = F.coalesce("_l", none), F.coalesce("_r", none)  # noqa: E741
    return both.select(key, F.array_sort(F.array_intersect(l, r)).alias("shared"), F.array_sort(F.array_except(l, r)).alias("only_left"), F.array_sort(F.array_except(r, l)).alias("only_right"))


def filled(rows: DataFrame, confirmed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Empty cells filled from the confirmed record of the same key."""
    other = confirmed.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(other, key, "left")
    return joined.select(*[F.coalesce(F.nullif(c, F.lit("")), f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, old, new, change) of two snapshots: added, removed, changed or same; numbers within a hundredth are the same."""
    both = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key, "full")
    apart = F.try_divide(F.abs(F.col("new") - F.col("old")), F.greatest(F.abs("old"), F.abs("new")))
    same = (F.col("old") == F.col("new")) | (apart < 0.01)
    return both.withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(same, "same").otherwise("changed"))
