"""Order-dependent operators over keyed sequences: running best, failure runs, pace, leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from brindle.sources.shared import written


def _before(key: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def running_best(rows: DataFrame, key: list[str], order: list[str], metric: str) -> DataFrame:
    """``rows`` with the best metric before each, whether it improves on it, and rows since the last improvement."""
    until = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    out = rows.withColumn("best_before", F.max(metric).over(_before(key, order))).withColumn("_place", place)
    out = out.withColumn("improved", F.col("best_before").isNull() | (F.col(metric) > F.col("best_before")))
    last = F.max(F.when(F.col("improved"), F.col("_place"))).over(until)
    return out.withColumn("since_improved", F.col("_place") - last).drop("_place")


def trailing_failures(rows: DataFrame, key: list[str], order: Column, failed: Column) -> DataFrame:
    """Failures of each key after its last success, without sorting: the last success is aggregated first."""
    last = rows.groupBy(*key).agg(F.max(F.when(~failed, order)).alias("_last"))
    tail = rows.join(last, key).where(failed & (F.col("_last").isNull() | (order > F.col("_last"))))
    counted = tail.groupBy(*key).agg(F.count(F.lit(1)).alias("trailing"))
    return last.select(*key).join(counted, key, "left").na.fill(0, ["trailing"])


def dense_ranks(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``number``, the dense rank by a column over the whole table; rows without a value have none.

    Values are dealt out by ranges, ranked where they are, and moved on by how many values the ranges before hold: as many
    counts as there are ranges come to the driver, and no task sees more than a range. Equal values share a range.
    """
    values = rows.select(order).where(F.col(order).isNotNull()).distinct()
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(values.repartitionByRange(n, order).withColumn("_range", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for row in dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect():
        offsets.append((row["_range"], before))
        before += row["n"]
    shift = rows.sparkSession.createDataFrame(offsets, "_range int, _before long")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    ranked = dealt.withColumn("_own", own).join(F.broadcast(shift), "_range").select(order, (F.col("_before") + F.col("_own")).alias("number"))
    return rows.join(ranked, order, "left")
