"""Streaming forms: windows over late events, feedback to arms, breakers as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kindred.operators.bandit import feedback_outcomes, update_arms
from kindred.operators.workers import FAILURES, OPEN_SECONDS


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums of each kind of event in windows of ``size``."""
    return _counts(_watermarked(events, late), F.window("ts", size))


def sliding(events: DataFrame, size: str, step: str, late: str = "1 hour") -> DataFrame:
    return _counts(_watermarked(events, late), F.window("ts", size, step))


def _counts(events: DataFrame, window: Column) -> DataFrame:
    return events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """A user's events without a break of ``gap``."""
    w = F.session_window("ts", gap)
    return _watermarked(events, late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return _watermarked(events, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def breakers(events: DataFrame, failures: int = FAILURES, open_seconds: int = OPEN_SECONDS) -> DataFrame:
    """A row whenever a worker's breaker opens or closes: worker_id, at, state.

    ``events``: worker_id, at, ok. State is a count, a flag and the second of
    the last failure for each worker.
    """

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, is_open, last = state.get if state.exists else (0, False, 0)
        out = []
        for frame in frames:
            for at, ok in frame.sort_values("at")[["at", "ok"]].itertuples(index=False):
                second = int(at.timestamp())
                if is_open and second - last >= open_seconds:
                    is_open = False
                    count = failures - 1  # half open: one more failure opens it again
                    out.append((key[0], at, "half_open"))
                if ok:
                    if count >= failures or is_open:
                        out.append((key[0], at, "closed"))
                    count, is_open = 0, False
                else:
                    count, last = count + 1, second
                    if count >= failures and not is_open:
                        is_open = True
                        out.append((key[0], at, "open"))
        state.update((count, is_open, last))
        yield pd.DataFrame(out, columns=["worker_id", "at", "state"])

    kind = events.schema["worker_id"].dataType.simpleString()
    return events.select("worker_id", "at", "ok").groupBy("worker_id").applyInPandasWithState(fold, f"worker_id {kind}, at timestamp, state string", "failures int, open boolean, last long", "append", GroupStateTimeout.NoTimeout)


def learn_arms(feedback: DataFrame, decisions: DataFrame, arms_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep arms, a Parquet table with a column ``version``, up to date with a feedback stream.

    Every micro-batch writes the next version under its own number, so a
    repeated batch overwrites what it wrote before.
    """
    spark = feedback.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        arms = spark.read.parquet(arms_path).where(F.col("version") <= number)
        last = arms.agg(F.max("version")).first()[0]
        new = update_arms(arms.where(F.col("version") == last).drop("version"), feedback_outcomes(batch, decisions))
        new.withColumn("version", F.lit(number + 1)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(arms_path)

    return feedback.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_periodically(source: DataFrame, step, checkpoint: str, seconds: int) -> StreamingQuery:
    """Call ``step(batch, number)`` every ``seconds``; the query's ``stop``, ``status`` and ``lastProgress`` control and show it."""
    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
