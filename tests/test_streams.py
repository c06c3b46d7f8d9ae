"""State of streams: what is pushed, and what is forgotten."""

import glob
from datetime import datetime

import pandas as pd

from brindle.streaming import events


def test_throttled_state_is_forgotten(spark, tmp_path):
    shape = "user_id long, ts timestamp, payload string"
    rows = [[(u, f"2024-01-0{day} 00:{m:02}:00", p) for u in users for m, p in ((0, "a"), (10, "a"), (20, "b"), (59, "b"))] for day, users in ((1, (1, 2, 3)), (5, (4,)), (9, (1,)), (9, (5,)))]
    for k, batch in enumerate(rows):
        day = spark.createDataFrame([(u, datetime.fromisoformat(t), p) for u, t, p in batch], shape).coalesce(1)
        day.write.parquet(f"{tmp_path}/in/{k}")
    for k in range(len(rows)):
        part = glob.glob(f"{tmp_path}/in/{k}/*.parquet")[0]
        pd.read_parquet(part).to_parquet(f"{tmp_path}/part{k}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("latestFirst", False).option("pathGlobFilter", "part*.parquet").parquet(str(tmp_path))
    pushed = events.collected(events.throttled(stream, 3600, "1 hour"), f"file://{tmp_path}/out", "beats")
    got = sorted((r.user_id, str(r.ts), r.payload) for r in pushed.collect())
    wanted = sorted((u, f"2024-01-0{day} 00:{m}:00", p) for day, users in ((1, (1, 2, 3)), (5, (4,)), (9, (1,)), (9, (5,))) for u in users for m, p in (("00", "a"), ("20", "b")))
    assert got == wanted
    state = spark.read.format("statestore").option("stateVarName", "pushed").load(f"file://{tmp_path}/out/state")
    held = {r.key.user_id for r in state.collect()}
    assert held <= {1, 5} and not held & {2, 3, 4}
