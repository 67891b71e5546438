"""Incremental usage statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from corpusloom.operators.usage import hourly_activity
from corpusloom.sources.snapshots import Snapshot


def activity(events: DataFrame, span: str = "1 day", late: str = "1 hour", exact: bool = True) -> DataFrame:
    """Tumbling event counts and active users; rows behind the watermark are dropped.

    Exact actives come from two chained aggregates: first per (window, user), where one busy user is a
    single state row, then per window.  ``exact=False`` keeps a sketch per window instead.
    """
    marked = events.withWatermark("ts", late)
    if not exact:
        return marked.groupBy(F.window("ts", span).alias("w")).agg(
            F.count(F.lit(1)).alias("n_events"), F.approx_count_distinct("user_id").alias("n_users")
        ).select(F.col("w.start").alias("window_start"), "n_events", "n_users")
    per_user = marked.groupBy(F.window("ts", span), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_user.groupBy(F.window(F.window_time("window"), span).alias("w"))
        .agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_users"))
        .select(F.col("w.start").alias("window_start"), "n_events", "n_users")
    )


def stream_activity(events: DataFrame, target: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Append finished windows to a Parquet table."""
    return (
        activity(events, **options)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def sketches(events: DataFrame, late: str = "1 hour", event: str = "event_id", lg_k: int = 12, exact: bool = False) -> DataFrame:
    """The hourly table of ``hourly_activity`` from a stream; an event delivered again within ``late`` counts once.

    ``events(event_id, user_id, sender_type, created_at)``.  Each hour is one row of state with one sketch, or
    with ``exact`` a fixed number of rows with sets of users.
    """
    once = events.withWatermark("created_at", late).dropDuplicatesWithinWatermark([event])
    return hourly_activity(once, lg_k, hour=F.window("created_at", "1 hour"), exact=exact).withColumn("hour", F.col("hour.start"))


def stream_sketches(events: DataFrame, target: str, checkpoint: str, **options: str | bool) -> StreamingQuery:
    """Append the rows of finished hours to a Parquet table."""
    return (
        sketches(events, **options)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest(events: DataFrame, key: str, order: tuple[str, ...], value: tuple[str, ...]) -> DataFrame:
    """Current newest event per key; one state row per key."""
    newest = F.max_by(F.struct(*order, *value), F.struct(*order))
    return events.groupBy(key).agg(newest.alias("m")).select(key, "m.*")


def stream_latest(
    events: DataFrame, target: str, checkpoint: str, key: str, order: tuple[str, ...], value: tuple[str, ...], compact_after: int = 8
) -> StreamingQuery:
    """Replace the changed keys of every micro-batch in a snapshot; a repeated batch is known there."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store = Snapshot(batch.sparkSession, target, key)
        store.replace({"latest": batch}, writer="latest", batch=batch_id)
        store.compact(compact_after)

    return (
        latest(events, key, order, value)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The newest version of every key."""
    return Snapshot(spark, target, key).table("latest")
