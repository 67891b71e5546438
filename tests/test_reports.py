"""The whole statistics report, and reports from hourly sketches against exact counts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import usage as G
from corpusloom.streaming import usage as U

NOW = datetime(2026, 3, 10, 12)


def ago(**kw):
    return NOW - timedelta(**kw)


def report(spark, messages, talks, users, name):
    rows = G.statistics_report(
        spark.createDataFrame(messages, "conv_id int, sender_type string, created_at timestamp"),
        spark.createDataFrame(talks, "conv_id int, user_id int, created_at timestamp"),
        spark.createDataFrame(users, "user_id int, role_id int"),
        spark.createDataFrame([(1, "user"), (2, "admin")], "role_id int, name string"),
        spark.range(4), NOW, name, topic="advice",
    ).collect()
    return {(r.part, r.position): (r.label, r.value, r.previous, r.delta_pct) for r in rows}


def test_statistics_report(spark):
    talks = [(1, 1, ago(days=7)), (2, 1, ago(days=1)), (3, 2, ago(seconds=1)), (4, 3, ago(days=8)), (5, 4, NOW), (6, None, ago(days=1))]
    messages = [(1, "user", ago(days=7)), (2, "user", ago(days=1)), (3, "user", ago(days=2)), (4, "user", ago(days=9)), (5, "user", NOW), (6, "user", ago(days=1)),
                (1, "assistant", ago(days=7, seconds=1)), (2, "assistant", ago(days=1)), (None, "assistant", ago(days=1)), (3, "system", ago(days=1)), (2, None, ago(days=1))]
    got = report(spark, messages, talks, [(1, 1), (2, 2), (3, 1), (4, 1)], "7d")
    assert got[("metric", 0)] == ("active_users", 1, 1, 0.0)  # user 2 is an admin, user 4 comes too late
    assert got[("metric", 1)] == ("conversations", 4, 1, 300.0)
    assert got[("metric", 2)] == ("answered", 2, 1, 100.0)
    assert got[("metric", 3)] == ("total_documents", 4, None, None)
    assert got[("topic", 0)] == ("advice", 4, None, None)
    assert [got[("chart", i)][:2] for i in range(6)] == [("03/03", 1), ("04/03", 0), ("05/03", 0), ("07/03", 0), ("08/03", 0), ("09/03", 3)]
    assert len(got) == 11


def test_statistics_report_of_nothing(spark):
    got = report(spark, [], [], [], "24h")
    assert [got[("metric", i)][1:] for i in range(3)] == [(0, 0, None)] * 3
    assert [got[("chart", i)] for i in range(6)] == [(h, 0, None, None) for h in ("12:00", "16:00", "20:00", "00:00", "04:00", "08:00")]
    assert got[("topic", 0)][1] == 0


def test_error_of_united_sketches_is_bounded(spark):
    """60,000 users over 60 days, each in many hours; the bound is four standard errors."""
    hour = F.lit(ago(days=60)) + F.make_dt_interval(hours=F.pmod(F.xxhash64("id"), F.lit(1440)).cast("int"))
    rows = spark.range(400000, numPartitions=4).select(
        F.pmod(F.xxhash64("id", F.lit(7)), F.lit(60000)).alias("user_id"), F.when(F.col("id") % 4 == 0, "assistant").otherwise("user").alias("sender_type"), hour.alias("created_at")
    )
    hourly = G.hourly_activity(rows)
    assert hourly.count() == 1440
    got = {(r.range, r.metric): (r.value, r.previous) for r in G.sketch_report(hourly, NOW).collect()}
    for name, hours in (("24h", 24), ("7d", 168), ("30d", 720)):
        for i, end in enumerate((NOW, NOW - timedelta(hours=hours))):
            part = rows.filter((F.col("created_at") >= F.lit(end - timedelta(hours=hours))) & (F.col("created_at") < F.lit(end)))
            exact, asked, answered = part.agg(
                F.count_distinct(F.when(F.col("sender_type") == "user", F.col("user_id"))), F.count_if(F.col("sender_type") == "user"), F.count_if(F.col("sender_type") == "assistant")
            ).first()
            assert abs(got[(name, "active_users")][i] - exact) <= 4 * 1.04 / 64 * exact
            assert (got[(name, "asked")][i], got[(name, "answered")][i]) == (asked, answered)


def test_sketch_report_without_rows_and_off_the_hour(spark):
    hourly = G.hourly_activity(spark.createDataFrame([], "user_id int, sender_type string, created_at timestamp"))
    assert {(r.value, r.previous, r.delta_pct) for r in G.sketch_report(hourly, NOW, ["7d"]).collect()} == {(0, 0, None)}
    with pytest.raises(ValueError, match="full hours"):
        G.sketch_report(hourly, NOW + timedelta(minutes=1))


def test_stream_of_sketches_counts_redelivered_events_once(spark, tmp_path):
    schema = "event_id int, user_id int, sender_type string, created_at timestamp"
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        U.stream_sketches(spark.readStream.schema(schema).parquet(source), target, marks).awaitTermination()
        return {(r.hour, r.asked, r.answered) for r in spark.read.parquet(target).collect()}

    base = [(1, 1, "user", ago(hours=5)), (2, 1, "user", ago(hours=5)), (3, 2, "assistant", ago(hours=5)), (4, 3, "user", ago(hours=4))]
    deliver(base)
    deliver(base[3:] + [(5, 3, "user", ago(hours=1))])
    done = deliver([(6, 4, "user", ago(hours=5)), (7, 4, "user", NOW)])  # the first one is behind the watermark
    assert done >= {(ago(hours=5), 2, 1), (ago(hours=4), 1, 0)}
    value = {r.metric: r.value for r in G.sketch_report(spark.read.parquet(target), ago(hours=3), ["24h"]).collect()}
    assert value == {"active_users": 2, "asked": 3, "answered": 1}


def test_exact_report_counts_every_user(spark, tmp_path):
    """20,000 users are beyond what a sketch holds; a null user sends and answers but is no user."""
    schema = "event_id bigint, user_id bigint, sender_type string, created_at timestamp"
    rows = spark.range(60000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 50 > 0, F.col("id") % 20000).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("sender_type"),
        (F.lit(ago(days=1)) + F.make_dt_interval(hours=(F.col("id") % 23).cast("int"))).alias("created_at"),
    )
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    rows.unionByName(spark.createDataFrame([(-1, None, "system", NOW + timedelta(days=1))], schema)).write.parquet(source)
    U.stream_sketches(spark.readStream.schema(schema).parquet(source), target, marks, exact=True).awaitTermination()
    sent = rows.where("sender_type = 'user'")
    want = {"active_users": sent.select("user_id").na.drop().distinct().count(), "asked": sent.count(), "answered": 60000 - sent.count()}
    for hourly in (G.hourly_activity(rows, exact=True), spark.read.parquet(target)):
        assert {r.metric: r.value for r in G.sketch_report(hourly, NOW, ["24h"]).collect()} == want
