"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

import atexit
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.runtime import dropped, scratch

BREAKER = "user_id long, failures long, halted_at timestamp"
STATE = "streak int, rung int, failures long, halted timestamp"


def breaker(events: DataFrame, longest: int = 3, rungs: int = 3) -> DataFrame:
    """events(user_id, ts, event_id, failed), streamed -> after each batch the user's failures so far and when it halted: three
    failures in a row take a rung of the pause ladder, one more than it has halts, a success takes all back. Events of a
    batch are taken in the order of (ts, event_id); a key's state is a few numbers."""

    def step(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        streak, rung, failures, halted = state.get if state.exists else (0, 0, 0, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for ts, failed in zip(rows["ts"], rows["failed"], strict=True):
            if not failed:
                streak = rung = 0
                continue
            failures += 1
            streak += 1
            if streak == longest:
                streak, rung = 0, rung + 1
                if rung > rungs and halted is None:
                    halted = ts.to_pydatetime()
        state.update((streak, rung, failures, halted))
        yield pd.DataFrame({"user_id": [key[0]], "failures": [failures], "halted_at": [halted]}).astype({"halted_at": "datetime64[us]"})

    return events.groupBy("user_id").applyInPandasWithState(step, BREAKER, STATE, "update", "NoTimeout")


def quiet_periods(events: DataFrame, gap: str, watermark: str = "1 day") -> DataFrame:
    """user_id, first, last, n: events saved once a quiet period is over; streamed or not."""
    held = events.withWatermark("ts", watermark).groupBy("user_id", F.session_window("ts", gap))
    return held.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("session_window")


def once(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """Runs a stream over what there is and returns what it put out, written as a table under spark.checkpoint.dir. Only a
    local session may leave that unset."""
    path = scratch(spark)
    atexit.register(dropped, spark, path)
    # A batch that runs again after a failure writes over what it had written
    save = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
