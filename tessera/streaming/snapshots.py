"""Snapshots that arrive as a stream: each batch is compared with the state so far. Also event windows with late data."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, match

CHANGE = "id string, status string"


def compare_batch(base: DataFrame, batch: DataFrame) -> DataFrame:
    """Statuses of a batch's symbols against the state, by id; the last row of an id in the batch counts."""
    head = batch.groupBy("id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "id"]), "seq").alias("x")).select("id", "x.*").drop("seq")
    base = base.select(*head.columns)
    full = diff.paired(base, head, match.by_id(base, head)).select(F.col("head_id").alias("id"), "status")
    new = head.join(base.select("id"), "id", "left_anti").select("id", F.lit("added").alias("status"))
    return full.where("status <> 'unchanged'").unionByName(new)


def follow(spark: SparkSession, stream: DataFrame, state: str, changes: str, checkpoint: str):
    """Starts a query that writes each batch's changes and then moves the state, a folder of Parquet, forward. A batch
    that runs again finds its own state folder and gives the same rows."""

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        before = spark.read.parquet(f"{state}/{number}")
        compare_batch(before, batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{changes}/batch={number}")
        last = batch.groupBy("id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "id"]), "seq").alias("x")).select("id", "x.*").drop("seq")
        old = before.join(last.select("id"), "id", "left_anti")
        old.unionByName(last.select(*before.columns)).write.mode("overwrite").parquet(f"{state}/{number + 1}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """events(ts, event_type, value) -> counts and sums by window and type; rows later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "5 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def failure_streaks(events: DataFrame, length: int = 3) -> DataFrame:
    """events(user_id, ts, failed), in order of arrival -> a row whenever a user's failures in a row reach `length`; a
    success starts the count anew. The state is one number a user."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        out = []
        for pdf in batches:
            for ts, failed in sorted(zip(pdf.ts, pdf.failed, strict=True)):
                n = n + 1 if failed else 0
                if n == length:
                    out.append((key[0], ts, n))
        state.update((n,))
        yield pd.DataFrame(out, columns=["user_id", "ts", "streak"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, ts timestamp, streak int", "n int", "append", "NoTimeout")
