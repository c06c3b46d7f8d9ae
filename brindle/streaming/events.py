"""Event streams: deduplication by id, routing counts by window, replayed from Parquet with AvailableNow."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

#: The state store that typed state and timers need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def source(spark: SparkSession, folder: str, glob: str = "events.parquet*", files_per_trigger: int = 4) -> DataFrame:
    """The events table of a folder as a stream; the number of files a trigger takes is the poll's budget."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Events by kind and window, each id once within the watermark; state older than the watermark is evicted."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))


def replay(counts: DataFrame, checkpoint: str, name: str) -> DataFrame:
    """Run a stream over what is there now, into files: each batch's whole result replaces that of the one before."""
    spark, path = counts.sparkSession, f"{checkpoint}/{name}"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(path)


class Throttle(StatefulProcessor):
    """The last push of a user, typed, until a timer at its interval's end clears it: from then on any beat is pushed anyway."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pushed = handle.getValueState("pushed", "last long, payload string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        beats = pd.concat(list(rows)).sort_values(["ts", "payload"])
        last, payload = self.pushed.get() if self.pushed.exists() else (None, None)
        before, out = last, []
        for at, value in zip(beats["ts"], beats["payload"], strict=True):
            second = at.value // 10**9
            if last is None or value != payload or second - last >= self.seconds:
                out.append((key[0], at, value))
                last, payload = second, value
        if last != before:
            if before is not None:
                self.handle.deleteTimer((before + self.seconds) * 1000)
            self.handle.registerTimer((last + self.seconds) * 1000)
        self.pushed.update((last, payload))
        yield pd.DataFrame(out, columns=["user_id", "ts", "payload"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.pushed.clear()
        yield pd.DataFrame([], columns=["user_id", "ts", "payload"])

    def close(self) -> None:
        pass


def throttled(beats: DataFrame, seconds: int, late: str = "1 day") -> DataFrame:
    """(user_id, ts, payload) of the beats that are pushed: the first, and any whose payload changed or whose
    interval passed since the last push.

    State is one row a user whose last push is within ``seconds`` of the watermark; a timer clears it after that, which
    changes nothing, as the next beat is pushed whatever it holds. So state follows the users of an interval, not all.
    """
    kept = beats.select("user_id", "ts", "payload").withWatermark("ts", late)
    return kept.groupBy("user_id").transformWithStateInPandas(Throttle(seconds), "user_id long, ts timestamp, payload string", "Append", "EventTime")


def fresh_ids(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events whose id was not seen within the watermark; older ids are forgotten, so that state is bounded by time."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that typed state needs, for the streams that are started inside."""
    name, wanted = PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def collected(stream: DataFrame, checkpoint: str, name: str) -> DataFrame:
    """Run an appending stream over what is there now, into files."""
    spark, path = stream.sparkSession, f"{checkpoint}/{name}"
    with typed_state(spark):
        stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
