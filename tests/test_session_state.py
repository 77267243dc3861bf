"""Session context in event time against a plain version, with files out of order."""

import random
from zlib import crc32

import pandas as pd
from pyspark.sql import functions as F

from shellgauge.session import scratch
from shellgauge.streaming import session_state


def brute(rows, budget, turn_cost, idle_ms):
    out, by = {}, {}
    for s, i, ts, text in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        turns, total, last = by.get(s, ([], 0, None))
        if last is not None and (ts - last).total_seconds() * 1000 > idle_ms:
            turns, total = [], 0
        kept, used = [], 0
        for t in reversed(turns):
            if kept and used + len(t) + turn_cost > budget:
                break
            kept.append(t)
            used += len(t) + turn_cost
        out[i] = (s, kept[::-1], total)
        by[s] = ([*turns, text], total + 1, ts)
    return out


def test_event_order_over_batches(spark):
    session_state.use_state_store(spark)
    rng = random.Random(4)
    start = pd.Timestamp("2024-01-01")
    rows = [(f"s{rng.choice([0, 0, 0, 1, 2])}", f"c{k:03}", start + pd.Timedelta(minutes=rng.randint(0, 2000)), "x" * rng.randint(1, 30)) for k in range(150)]
    rows += [("s9", "last", start + pd.Timedelta(days=30), "end")]
    folder = scratch(spark, "files")
    # a file holds calls of one stretch of arrivals; calls arrive up to 50 minutes late, in any order
    for at in range(5):
        part = [r for r in rows if (5 * ((r[2] - start).total_seconds() / 60 + crc32(r[1].encode()) % 50) // 2060 if r[1] != "last" else 4) == at]
        rng.shuffle(part)
        frame = pd.DataFrame(part, columns=["session_id", "tool_use_id", "ts", "call_text"])
        spark.createDataFrame(frame).coalesce(1).write.mode("append").parquet(f"{folder}")
    schema = "session_id string, tool_use_id string, ts timestamp, call_text string"
    calls = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = scratch(spark, "out")
    history = session_state.stream_session_context(calls, "1 hour", 60, 8, 3_600_000 * 3)
    history.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r["tool_use_id"]: (r["session_id"], list(r["prior_actions"]), r["actions_total"]) for r in spark.read.parquet(out).collect()}
    want = brute(rows, 60, 8, 3_600_000 * 3)
    del want["last"]
    assert got == want
    assert spark.read.parquet(out).filter(F.size("prior_actions") > 1).count() > 20
