from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusloom.operators import quality as H
from corpusloom.operators import sections as X
from corpusloom.operators import usage as G
from corpusloom.sources import tables as A
from corpusloom.streaming import ingest as I
from corpusloom.streaming import usage as U

NOW = datetime(2026, 3, 10, 12)
MSG = "message_id int, conv_id int, user_id int, sender_type string, created_at timestamp"


def ago(**kw):
    return NOW - timedelta(**kw)


def messages(spark):
    rows = [(1, 1, 1, "user", ago(days=1)), (2, 1, 1, "assistant", ago(days=1)), (3, 2, 2, "user", ago(days=6, hours=23)), (4, 2, 2, "assistant", ago(days=2)),
            (5, 3, 1, "user", ago(days=8)), (6, 3, 1, "assistant", ago(days=8)), (7, 4, 9, "user", ago(days=1)), (8, 5, 1, "user", NOW), (9, 5, 1, "user", ago(days=14, seconds=1))]
    return spark.createDataFrame(rows, MSG)


def test_period_report(spark):
    members = messages(spark).filter("user_id <> 9")
    talks = spark.createDataFrame([(ago(days=d),) for d in (1, 2, 3, 7, 8)] + [(NOW,)], "created_at timestamp")
    got = {r["metric"]: tuple(r)[1:] for r in G.period_report(members, talks, NOW, "7d", spark.range(3)).collect()}
    assert got == {"active_users": (2, 1, 100.0), "answered": (2, 1, 100.0), "conversations": (4, 1, 300.0), "total_documents": (3, None, None)}


def test_period_report_empty(spark):
    got = {r["metric"]: tuple(r)[1:] for r in G.period_report(messages(spark).limit(0), messages(spark).limit(0), NOW, "24h").collect()}
    assert got == {m: (0, 0, None) for m in ("active_users", "answered", "conversations")}


def test_active_users_excludes_other_roles(spark):
    convs = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 9), (5, 1)], "conv_id int, user_id int")
    users = spark.createDataFrame([(1, 1), (2, 1), (9, 2)], "user_id int, role_id int")
    roles = spark.createDataFrame([(1, "user"), (2, "admin")], "role_id int, name string")
    count = lambda a, b: G.active_users(messages(spark), convs, users, roles, a, b).first()[0]
    assert count(ago(days=7), NOW) == 2 and count(ago(days=14), ago(days=7)) == 1


def test_buckets(spark):
    start, span = ago(hours=24), timedelta(hours=24)
    stamps = [start, start + timedelta(hours=4) - timedelta(microseconds=1), start + timedelta(hours=4), NOW - timedelta(microseconds=1), NOW]
    rows = G.time_buckets(spark.createDataFrame([(s,) for s in stamps], "created_at timestamp"), start, span).orderBy("bucket").collect()
    assert [r["count"] for r in rows] == [2, 1, 0, 0, 0, 2]
    assert [r["label"] for r in rows] == ["12:00", "16:00", "20:00", "00:00", "04:00", "08:00"]
    empty = G.time_buckets(spark.createDataFrame([], "created_at timestamp"), ago(days=30), timedelta(days=30)).orderBy("bucket").collect()
    assert [r["count"] for r in empty] == [0] * 6 and empty[0]["label"] == "08/02"


def test_latest_list_and_title(spark):
    rows = [(1, 1, "user", "  \n", NOW), (2, 1, "user", " Câu hỏi " + "x" * 100, NOW), (3, 1, "assistant", "y" * 200, NOW), (4, 2, "user", "b", ago(days=1))]
    msgs = spark.createDataFrame(rows, "message_id int, conv_id int, role string, content string, created_at timestamp")
    assert {r["conv_id"]: r["message_id"] for r in G.latest_per_group(msgs, ["conv_id"], ["created_at", "message_id"]).collect()} == {1: 3, 2: 4}
    convs = spark.createDataFrame([(1, 1, ago(days=2)), (2, 1, NOW), (3, 2, ago(days=1))], "conv_id int, user_id int, updated_at timestamp")
    got = [(r["conv_id"], r["last_message"]) for r in G.conversation_list(convs, msgs).collect()]
    assert got == [(2, "b"), (3, None), (1, "y" * 120)]
    viewer = spark.createDataFrame([(2,)], "user_id int")
    assert [r["conv_id"] for r in G.conversation_list(convs, msgs, viewer).collect()] == [3]
    titles = G.derived_title(msgs.withColumnRenamed("content", "text"), order="message_id").collect()
    assert {r["conv_id"]: r["title"] for r in titles} == {1: ("Câu hỏi " + "x" * 100)[:60], 2: "b"}


def test_history_of_a_hot_conversation(spark):
    n = 3000
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f" t{t} ") for t in range(n)] + [(2, 10 * t, "user", f"u{t}") for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(4)
    placed = X.with_position(df, ["conv_id"], ["turn"], F.floor(F.col("turn") / 100))
    assert placed.filter("conv_id = 1 and pos <> turn").count() == 0
    assert [r["pos"] for r in placed.filter("conv_id = 2").orderBy("turn").collect()] == [0, 1, 2, 3]
    windows = X.preceding_rows(placed, ["conv_id"], "pos", 5, F.col("text"), "history", block=64)
    got = {(r["conv_id"], r["pos"]): r["history"] for r in windows.collect()}
    assert len(got) == n + 4
    assert all(got[(1, t)] == [f" t{i} " for i in range(max(0, t - 5), t)] for t in range(n))
    last = G.history_window(df, section=F.floor(F.col("turn") / 100)).filter("conv_id = 1 and turn = 2998")
    assert last.select(G.format_history(F.col("history")).alias("h")).first()["h"].split("\n")[-1] == "assistant: t2997"
    assert G.history_window(df).filter("role <> 'user'").count() == 0


def test_thread_and_documents(spark):
    df = spark.createDataFrame([(1, 2, None), (1, 1, ["s"])], "conv_id int, turn int, sources array<string>")
    assert [(r["turn"], r["sources"]) for r in G.message_thread(df, ["turn"]).collect()] == [(1, ["s"]), (2, [])]
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "document_id int, name string")
    chunks = spark.createDataFrame([(1, 1, "y"), (1, 0, "x")], "document_id int, chunk_index int, content string")
    got = [(r["document_id"], r["chunk_count"], r["content"]) for r in G.document_with_chunks(docs, chunks).collect()]
    assert got == [(1, 2, "x"), (1, 2, "y"), (2, 0, None)]


def test_replace_and_delete(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "document_id int, filename string")
    new = spark.createDataFrame([(9, "a"), (8, "c")], "document_id int, filename string")
    assert {tuple(r) for r in A.replace_by_name(old, new).collect()} == {(2, "b"), (9, "a"), (8, "c")}
    chunks = spark.createDataFrame([(1, "v1"), (1, None), (2, "v2")], "document_id int, vector_id string")
    gone = A.delete_cascade(old, chunks, spark.createDataFrame([(1,), (7,)], "document_id int"))
    assert gone["deleted"].first()[0] == 1 and [r[0] for r in gone["vectors"].collect()] == ["v1"] and gone["chunks"].count() == 1
    every = A.delete_cascade(old, chunks, None)
    assert (every["documents"].count(), every["vectors"].count(), every["deleted"].first()[0]) == (0, 2, 3)


CHUNK = "id int, content string, has_table boolean, grid array<array<string>>, context string, token_count int, vector_id string, heading_path array<string>"


def test_chunk_flags(spark):
    ok = ["nội dung", False, None, "ctx", 10, "u", ["A"]]

    def but(**kw):
        row = dict(zip(["content", "has_table", "grid", "context", "token_count", "vector_id", "heading_path"], ok))
        row.update(kw)
        return tuple(row.values())

    cases = [
        (but(), []),
        (but(content=" "), ["EMPTY_CONTENT"]),
        (but(has_table=True), ["TABLE_NO_DATA"]),
        (but(has_table=True, grid=[["a"]]), ["TABLE_MD_MISMATCH"]),
        (but(has_table=True, grid=[["a"]], content="|a|", heading_path=None), []),
        (but(context=" dung "), ["CONTEXT_IN_CONTENT"]),
        (but(token_count=1537), ["TOKEN_OUTLIER"]),
        (but(vector_id=None), ["VECTOR_ID_NULL"]),
        (but(heading_path=[]), ["HEADING_EMPTY"]),
    ]
    df = spark.createDataFrame([(i, *row) for i, (row, _) in enumerate(cases)], CHUNK)
    flagged = H.chunk_flags(df)
    assert [r["flags"] for r in flagged.orderBy("id").collect()] == [f for _, f in cases]
    report = {r["flag"]: (r["n"], r["percent"], r["heavy"]) for r in H.flag_report(flagged).collect()}
    assert report["TABLE_NO_DATA"] == (1, 11, True) and report["HEADING_EMPTY"] == (1, 11, False)
    assert tuple(H.passes_gate(flagged).first()) == (2, False) and tuple(H.passes_gate(flagged.filter("id = 0")).first()) == (0, True)


def test_sample(spark):
    df = spark.range(100).repartition(7)
    pick = lambda n, seed: sorted(r[0] for r in H.seeded_sample(df, n, seed, "id").collect())
    assert pick(5, 42) == pick(5, 42) and len(pick(5, 42)) == 5 and pick(5, 42) != pick(5, 43)
    assert len(pick(0, 1)) == 100 and len(pick(200, 1)) == 100


# --- streams -------------------------------------------------------------------------------------


def test_stream_ingest_redelivery(spark, tmp_path):
    from corpusloom.functions.markup import text_blocks

    src, out, marks = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")
    schema = "doc_id bigint, text string"

    def to_blocks(df):
        bad = F.when(F.col("text").isNull(), "unreadable")
        return df.withColumn("blocks", text_blocks("text")).withColumn("page_count", F.lit(1)).withColumn("has_content", F.col("text") != "").withColumn("error", bad)

    def deliver(*rows):
        spark.createDataFrame(list(rows), schema).write.mode("append").parquet(src)
        I.stream_ingest(spark.readStream.schema(schema).parquet(src), to_blocks, out, marks).awaitTermination()
        chunks, status = I.read_ingested(spark, out)
        return {(r["doc_id"], r["content"]) for r in chunks.collect()}, {r["doc_id"]: (r["status"], r["error_message"]) for r in status.collect()}

    deliver((1, "# A\nx"), (2, None), (3, ""))
    chunks, status = deliver((1, "# B\ny"), (4, "z"))
    assert chunks == {(1, "# B\n\ny"), (4, "z")}
    assert status == {1: ("ready", None), 2: ("failed", "unreadable"), 3: ("failed", "no content"), 4: ("ready", None)}


def test_stream_usage(spark, tmp_path):
    src = str(tmp_path / "ev")
    schema = "event_id bigint, ts timestamp, user_id bigint, kind string"
    day = datetime(2024, 1, 1)
    rows = [(i, day + timedelta(hours=5 * i), i % 3, f"k{i}") for i in range(20)]
    spark.createDataFrame(rows, schema).write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    U.stream_activity(stream(), str(tmp_path / "a"), str(tmp_path / "am")).awaitTermination()
    got = {r["window_start"]: (r["n_events"], r["n_users"]) for r in spark.read.parquet(str(tmp_path / "a")).collect()}
    want = {}
    for _, ts, user, _ in rows:
        want.setdefault(ts.replace(hour=0), []).append(user)
    final = {d: (len(u), len(set(u))) for d, u in want.items() if d + timedelta(days=1) <= rows[-1][1] - timedelta(hours=1)}
    assert got == final and len(final) == 3
    args = (str(tmp_path / "l"), str(tmp_path / "lm"), "user_id", ("ts", "event_id"), ("kind",))
    U.stream_latest(stream(), *args).awaitTermination()
    spark.createDataFrame([(99, day + timedelta(days=30), 1, "new"), (98, day, 2, "old")], schema).write.mode("append").parquet(src)
    U.stream_latest(stream(), *args).awaitTermination()
    assert {r["user_id"]: r["kind"] for r in U.read_latest(spark, args[0], "user_id").collect()} == {0: "k18", 1: "new", 2: "k17"}
