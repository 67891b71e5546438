"""Conversation and usage analytics.

Every period measure is an aggregate with a map-side part; distinct users are first reduced to one row
per user, so one user with most of the messages costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import rules
from corpusloom.functions.citations import delta_pct
from corpusloom.functions.text import is_blank, py_strip
from corpusloom.operators.sections import preceding_rows, with_position


def _stamp(value: datetime) -> Column:
    """A literal that takes on the type of the column it is compared with, so the filter is pushed down."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f"))


def _in_range(column: str, start: datetime, end: datetime) -> Column:
    return (F.col(column) >= _stamp(start)) & (F.col(column) < _stamp(end))


def active_users(
    messages: DataFrame,
    conversations: DataFrame,
    users: DataFrame,
    roles: DataFrame,
    start: datetime,
    end: datetime,
    role: str = "user",
    sender: str = "user",
) -> DataFrame:
    """Number of distinct users of a role with a user-sent message in [start, end).

    ``messages(conv_id, sender_type, created_at)``, ``conversations(conv_id, user_id)``,
    ``users(user_id, role_id)``, ``roles(role_id, name)``.  Messages shrink to distinct conversations
    before the first join and to distinct users before the second.
    """
    sent = messages.filter(_in_range("created_at", start, end) & (F.col("sender_type") == sender)).select("conv_id").distinct()
    people = sent.join(conversations.select("conv_id", "user_id"), "conv_id").select("user_id").distinct()
    wanted = roles.filter(F.col("name") == role).select("role_id")
    allowed = users.select("user_id", "role_id").join(wanted, "role_id").select("user_id")
    return people.join(allowed, "user_id", "left_semi").agg(F.count(F.lit(1)).alias("active_users"))


def count_conversations(conversations: DataFrame, start: datetime, end: datetime, created: str = "created_at") -> DataFrame:
    """Rows created in [start, end)."""
    return conversations.filter(_in_range(created, start, end)).agg(F.count(F.lit(1)).alias("conversations"))


def count_answered(messages: DataFrame, start: datetime, end: datetime, answerer: str = "assistant") -> DataFrame:
    """Messages sent by the assistant in [start, end)."""
    rows = messages.filter(_in_range("created_at", start, end) & (F.col("sender_type") == answerer))
    return rows.agg(F.count(F.lit(1)).alias("answered"))


def total_documents(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count(F.lit(1)).alias("total_documents"))


def bucket_index(ts: Column, start: datetime, span: timedelta, n: int) -> Column:
    """Index of the equal-width bucket of a timestamp, in whole microseconds, clamped to 0..n-1."""
    width = int(span / timedelta(microseconds=1))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    offset = micros(ts) - micros(_stamp(start))
    index = F.call_function("div", offset * n, F.lit(width))
    return F.greatest(F.lit(0), F.least(index, F.lit(n - 1))).cast("int")


def time_buckets(
    rows: DataFrame,
    start: datetime,
    span: timedelta,
    n: int = rules.BUCKETS,
    column: str = "created_at",
    intraday: bool | None = None,
) -> DataFrame:
    """Counts in ``n`` equal buckets of [start, start+span), empty buckets included, with a label.

    Rows outside the range count in the nearest bucket, so callers filter first.
    """
    intraday = span <= timedelta(hours=24) if intraday is None else intraday
    counts = rows.groupBy(bucket_index(F.col(column), start, span, n).alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    labels = [
        (i, (start + span / n * i).strftime("%H:%M" if intraday else "%d/%m")) for i in range(n)
    ]
    frame = rows.sparkSession.createDataFrame(labels, "bucket int, label string")
    return frame.join(counts, "bucket", "left").select("bucket", "label", F.coalesce("c", F.lit(0)).cast("long").alias("count"))


def period_report(
    messages: DataFrame,
    conversations: DataFrame,
    now: datetime,
    range_name: str = "7d",
    documents: DataFrame | None = None,
    user_sender: str = "user",
    answerer: str = "assistant",
) -> DataFrame:
    """Active users, conversations and answers of the current period against the one before.

    ``messages(user_id, sender_type, created_at)`` (users already restricted to the reported role),
    ``conversations(created_at)``.  One scan of each table covers both periods.
    """
    span = timedelta(hours=rules.RANGE_HOURS[range_name])
    middle, first = now - span, now - 2 * span
    current = _in_range("created_at", middle, now)
    flag = lambda c: F.max(c.cast("int"))
    count = lambda c: F.sum(c.cast("long"))
    window = messages.filter(_in_range("created_at", first, now))
    by_user = window.groupBy("user_id").agg(
        flag(current & (F.col("sender_type") == user_sender) & F.col("user_id").isNotNull()).alias("u1"),
        flag(~current & (F.col("sender_type") == user_sender) & F.col("user_id").isNotNull()).alias("u0"),
        count(current & (F.col("sender_type") == answerer)).alias("a1"),
        count(~current & (F.col("sender_type") == answerer)).alias("a0"),
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    people = by_user.agg(*[zero(c).alias(c) for c in ("u1", "u0", "a1", "a0")])
    talks = conversations.filter(_in_range("created_at", first, now)).agg(
        F.coalesce(count(current), F.lit(0)).alias("c1"), F.coalesce(count(~current), F.lit(0)).alias("c0")
    )
    rows = people.select(
        F.explode(
            F.array(
                F.struct(F.lit("active_users").alias("metric"), F.col("u1").alias("value"), F.col("u0").alias("previous")),
                F.struct(F.lit("answered").alias("metric"), F.col("a1").alias("value"), F.col("a0").alias("previous")),
            )
        ).alias("m")
    ).select("m.*")
    rows = rows.unionByName(talks.select(F.lit("conversations").alias("metric"), F.col("c1").alias("value"), F.col("c0").alias("previous")))
    out = rows.select("metric", "value", "previous", delta_pct("value", "previous").alias("delta_pct"))
    if documents is not None:
        none = lambda t: F.lit(None).cast(t)
        totals = total_documents(documents).select(
            F.lit("total_documents").alias("metric"),
            F.col("total_documents").alias("value"),
            none("long").alias("previous"),
            none("double").alias("delta_pct"),
        )
        out = out.unionByName(totals)
    return out


def statistics_report(
    messages: DataFrame,
    conversations: DataFrame,
    users: DataFrame,
    roles: DataFrame,
    documents: DataFrame,
    now: datetime,
    range_name: str = "7d",
    role: str = "user",
    topic: str = "all conversations",
    sender: str = "user",
    answerer: str = "assistant",
) -> DataFrame:
    """The whole report of a period as rows (part, position, label, value, previous, delta_pct).

    Part ``metric``: active users of ``role``, conversations, answers, and all documents.  Part ``chart``:
    the conversations of the period in equal buckets, empty ones included.  Part ``topic``: all of them
    under one label.  Tables as in ``active_users``, with ``conversations.created_at``.  Each metric of the
    current period stands beside the period before; messages are scanned once for both and shrink to one
    row per conversation before the join, conversations to one row per bucket.
    """
    span = timedelta(hours=rules.RANGE_HOURS[range_name])
    middle, first, n = now - span, now - 2 * span, rules.BUCKETS
    current = _in_range("created_at", middle, now)
    asked, answered = F.col("sender_type") == sender, F.col("sender_type") == answerer
    by_talk = messages.filter(_in_range("created_at", first, now) & (asked | answered)).groupBy("conv_id").agg(
        F.max((current & asked).cast("int")).alias("u1"),
        F.max((~current & asked).cast("int")).alias("u0"),
        F.count_if(current & answered).alias("a1"),
        F.count_if(~current & answered).alias("a0"),
    )
    owners = by_talk.filter("u1 + u0 > 0").select("conv_id", "u1", "u0").join(conversations.select("conv_id", "user_id"), "conv_id")
    allowed = users.select("user_id", "role_id").join(roles.filter(F.col("name") == role).select("role_id"), "role_id", "left_semi")
    people = owners.groupBy("user_id").agg(F.max("u1").alias("u1"), F.max("u0").alias("u0")).join(allowed, "user_id", "left_semi")
    bucket = F.when(current, bucket_index(F.col("created_at"), middle, span, n)).otherwise(-1)
    talks = conversations.filter(_in_range("created_at", first, now)).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))

    def total(rows: DataFrame, position: int, label: str, value: Column, previous: Column) -> DataFrame:
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        return rows.agg(zero(value).alias("value"), zero(previous).alias("previous")).select(
            F.lit("metric").alias("part"), F.lit(position).alias("position"), F.lit(label).alias("label"), "value", "previous"
        )

    here, before = F.when(F.col("bucket") >= 0, F.col("n")), F.when(F.col("bucket") < 0, F.col("n"))
    metrics = (
        total(people, 0, "active_users", F.col("u1"), F.col("u0"))
        .unionByName(total(talks, 1, "conversations", here, before))
        .unionByName(total(by_talk, 2, "answered", F.col("a1"), F.col("a0")))
    )
    labels = [(i, (middle + span / n * i).strftime("%H:%M" if span <= timedelta(hours=24) else "%d/%m")) for i in range(n)]
    frame = messages.sparkSession.createDataFrame(labels, "bucket int, label string")
    chart = frame.join(talks, "bucket", "left").select(
        F.lit("chart").alias("part"), F.col("bucket").alias("position"), "label", F.coalesce("n", F.lit(0)).cast("long").alias("value")
    )
    topics = talks.agg(F.coalesce(F.sum(here), F.lit(0)).cast("long").alias("value")).select(
        F.lit("topic").alias("part"), F.lit(0).alias("position"), F.lit(topic).alias("label"), "value"
    )
    every = total_documents(documents).select(
        F.lit("metric").alias("part"), F.lit(3).alias("position"), F.lit("total_documents").alias("label"), F.col("total_documents").alias("value")
    )
    out = metrics
    for rest in (every, chart, topics):
        out = out.unionByName(rest, allowMissingColumns=True)
    return out.withColumn("delta_pct", F.when(F.col("previous").isNotNull(), delta_pct("value", "previous")))


# --- reports from hourly sketches ----------------------------------------------------------------

SLOTS = 64  # sets of an hour's users


def hourly_activity(
    messages: DataFrame, lg_k: int = 12, sender: str = "user", answerer: str = "assistant", hour: Column | None = None, exact: bool = False
) -> DataFrame:
    """One row per hour: answers, user messages, and a sketch of the users who sent them.

    ``messages(user_id, sender_type, created_at)``, users restricted to the reported role.  Sketches of
    any hours can be united, so every later report reads this table instead of the messages.  A sketch
    has at most 2**lg_k registers; the standard error of a count is about 1.04 / sqrt(2**lg_k).
    ``exact=True`` keeps the users themselves instead, each hour's in ``SLOTS`` sets dealt by the user's hash.
    """
    asked = F.col("sender_type") == sender
    counts = [F.count_if(asked).alias("asked"), F.count_if(F.col("sender_type") == answerer).alias("answered")]
    hour = (F.date_trunc("hour", "created_at") if hour is None else hour).alias("hour")
    if exact:
        slot = F.pmod(F.xxhash64("user_id"), F.lit(SLOTS)).cast("int").alias("slot")
        return messages.groupBy(hour, slot).agg(*counts, F.collect_set(F.when(asked, F.col("user_id"))).alias("members"))
    return messages.groupBy(hour).agg(*counts, F.hll_sketch_agg(F.when(asked, F.col("user_id")), F.lit(lg_k)).alias("users"))


def sketch_report(hourly: DataFrame, now: datetime, ranges: Sequence[str] = tuple(rules.RANGE_HOURS)) -> DataFrame:
    """Every range and its period before from one scan of the hourly table: (range, metric, value, previous, delta_pct).

    ``now`` is a full hour.  From sketches active users are estimates, from sets of users they are exact; the other
    counts always are.
    """
    if now.replace(minute=0, second=0, microsecond=0) != now:
        raise ValueError("hourly sketches end at full hours")
    periods = []
    for name in ranges:
        span = timedelta(hours=rules.RANGE_HOURS[name])
        for period, end in (("value", now), ("previous", now - span)):
            inside = _in_range("hour", end - span, end)
            periods.append(F.when(inside, F.struct(F.lit(name).alias("range"), F.lit(period).alias("period"))))
    dealt = hourly.filter(_in_range("hour", now - 2 * timedelta(hours=max(rules.RANGE_HOURS[r] for r in ranges)), now))
    exact = "members" in hourly.columns
    dealt = dealt.withColumn("_p", F.explode(F.array_compact(F.array(*periods)))).select("_p.*", "asked", "answered", "members" if exact else "users")
    if exact:
        # the counts of a row go with its first user
        each = dealt.select("range", "period", "asked", "answered", F.posexplode_outer("members").alias("_at", "user_id"))
        once = [F.sum(F.when(F.coalesce("_at", F.lit(0)) == 0, F.col(c))).alias(c) for c in ("asked", "answered")]
        dealt = each.groupBy("range", "period", "user_id").agg(*once)
        users = F.count("user_id")
    else:
        users = F.hll_sketch_estimate(F.hll_union_agg("users"))
    sums = dealt.groupBy("range", "period").agg(users.alias("active_users"), F.sum("asked").alias("asked"), F.sum("answered").alias("answered"))
    measures = ("active_users", "asked", "answered")
    long = sums.select("range", "period", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in measures])).alias("m"))
    wide = long.groupBy("range", "m.metric").agg(
        *[F.coalesce(F.max(F.when(F.col("period") == p, F.col("m.v"))), F.lit(0)).cast("long").alias(p) for p in ("value", "previous")]
    )
    frame = hourly.sparkSession.createDataFrame([(r, m) for r in ranges for m in measures], "range string, metric string")
    filled = frame.join(wide, ["range", "metric"], "left").fillna(0, ["value", "previous"])
    return filled.select("range", "metric", "value", "previous", delta_pct("value", "previous").alias("delta_pct"))


def latest_per_group(messages: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each group by the order columns; only one candidate per group and task is shuffled."""
    rest = [c for c in messages.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return messages.groupBy(*keys).agg(newest.alias("m")).select(*keys, "m.*")


def conversation_list(
    conversations: DataFrame,
    messages: DataFrame,
    viewer: DataFrame | None = None,
    message_order: Sequence[str] = ("created_at", "message_id"),
    cut: int = rules.LAST_MESSAGE_CHARS,
) -> DataFrame:
    """Conversations, newest first, with the start of their last message (null without one).

    ``conversations(conv_id, user_id, updated_at, ...)``; with ``viewer(user_id)`` only owned rows.
    """
    owned = conversations if viewer is None else conversations.join(viewer.select("user_id").distinct(), "user_id", "left_semi")
    last = latest_per_group(messages.select("conv_id", *message_order, "content"), ["conv_id"], message_order)
    short = last.select("conv_id", F.substring("content", 1, cut).alias("last_message"))
    return owned.join(short, "conv_id", "left").orderBy(F.col("updated_at").desc(), "conv_id")


def message_thread(messages: DataFrame, order: Sequence[str] = ("created_at", "message_id")) -> DataFrame:
    """Messages of every conversation from old to new; missing sources become an empty list.

    The sort is by range over (conversation, order), so a long conversation is spread over tasks.
    """
    rows = messages
    if "sources" in messages.columns:
        kind = messages.schema["sources"].dataType
        rows = rows.withColumn("sources", F.coalesce("sources", F.array().cast(kind)))
    return rows.orderBy("conv_id", *order)


def history_window(
    messages: DataFrame,
    n: int = rules.HISTORY_MESSAGES,
    key: str = "conv_id",
    order: Sequence[str] = ("turn",),
    section: Column | None = None,
    asker: str = "user",
) -> DataFrame:
    """For each user message the up to ``n`` messages before it, oldest first, as ``history``.

    ``section`` is a coarse, non-decreasing function of the order (default: blocks of 1024 turns).
    """
    cut = F.floor(F.col(order[0]) / 1024) if section is None else section
    placed = with_position(messages, [key], order, cut)
    value = F.struct("role", "text")
    return preceding_rows(placed, [key], "pos", n, value, "history").filter(F.col("role") == asker)


def format_history(history: Column) -> Column:
    """"role: text" lines with trimmed text."""
    return F.array_join(F.transform(history, lambda m: F.concat(m["role"], F.lit(": "), py_strip(m["text"]))), "\n")


def derived_title(messages: DataFrame, key: str = "conv_id", order: str = "turn", cut: int = rules.TITLE_CHARS, asker: str = "user") -> DataFrame:
    """Title of each conversation: the start of its first non-blank question."""
    asked = messages.filter((F.col("role") == asker) & ~is_blank("text"))
    return asked.groupBy(key).agg(F.substring(py_strip(F.min_by("text", order)), 1, cut).alias("title"))


def document_with_chunks(documents: DataFrame, chunks: DataFrame, key: str = "document_id", index: str = "chunk_index") -> DataFrame:
    """Documents with their chunks in order, one row per chunk, and the chunk count on every row.

    A document without chunks keeps one row with nulls and a count of 0.  Rows stay flat: nesting all
    chunks of one document into a single row would put an unbounded group into one task.
    """
    counts = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    counted = documents.join(counts, key, "left").withColumn("chunk_count", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")
    # The large join is an inner one, because only there can AQE split a document with very many chunks.
    filled = counted.filter("chunk_count > 0").join(chunks, key)
    empty = counted.filter("chunk_count = 0")
    return filled.unionByName(empty, allowMissingColumns=True).orderBy(key, index)
