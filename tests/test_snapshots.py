"""Snapshots: replaced keys, crashes, redelivery, compaction of touched buckets only."""

import random

import pytest

from corpusloom.sources.snapshots import Snapshot

SCHEMA = "doc_id bigint, name string, part int"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def content(snapshot, name="chunks"):
    return sorted(tuple(r) for r in snapshot.table(name).collect()) if name in snapshot.manifest()["base"] else []


def test_random_changes_against_a_dictionary(spark, tmp_path):
    rng, want = random.Random(3), {}
    store = Snapshot(spark, str(tmp_path), "doc_id", buckets=4)
    for step in range(7):
        keys = rng.sample(range(12), 4)
        new = {k: [(k, f"{step}", p) for p in range(rng.randint(1, 3))] for k in keys[:3]}
        store.replace({"chunks": rows(spark, [r for v in new.values() for r in v])}, spark.createDataFrame([(k,) for k in keys], "doc_id bigint"))
        want.update(new)
        want.pop(keys[3], None)
        if step in (2, 5):
            assert store.compact() and not store.manifest()["changes"]
        assert content(Snapshot(spark, str(tmp_path), "doc_id")) == sorted(r for v in want.values() for r in v)
    assert store.expire(keep=1)
    assert content(store) == sorted(r for v in want.values() for r in v)


def test_a_crash_before_the_rename_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = Snapshot(spark, str(tmp_path), "doc_id", buckets=2)
    store.replace({"chunks": rows(spark, [(1, "old", 0)]), "status": rows(spark, [(1, "ok", 0)])}, writer="w", batch=0)

    def crash(state):
        raise OSError("gone")

    with monkeypatch.context() as broken:
        broken.setattr(store, "_publish", crash)
        for act in (lambda: store.replace({"chunks": rows(spark, [(1, "new", 0)])}, writer="w", batch=1), store.compact):
            with pytest.raises(OSError):
                act()
            assert content(store) == [(1, "old", 0)] and content(store, "status") == [(1, "ok", 0)]
    assert store.replace({"chunks": rows(spark, [(1, "new", 0)])}, writer="w", batch=1)
    assert not store.replace({"chunks": rows(spark, [(1, "twice", 0)])}, writer="w", batch=1)
    # The change names no status row of key 1, so that row is gone with the old chunk.
    assert content(store) == [(1, "new", 0)] and content(store, "status") == []


def test_two_writers_at_once(spark, tmp_path):
    store = Snapshot(spark, str(tmp_path), "doc_id", buckets=2)
    first, second = store.begin(), store.begin()
    for change, name in ((first, "a"), (second, "b")):
        change.put("chunks", rows(spark, [(1, name, 0)]))
    keys = spark.createDataFrame([(1,)], "doc_id bigint")
    first.commit([keys])
    with pytest.raises(RuntimeError, match="another writer"):
        second.commit([keys])
    assert content(store) == [(1, "a", 0)]


def test_readers_touch_base_and_open_changes_and_compaction_the_touched_buckets(spark, tmp_path):
    store = Snapshot(spark, str(tmp_path), "doc_id", buckets=8)
    store.replace({"chunks": rows(spark, [(k, "base", 0) for k in range(64)])})
    store.compact()
    before = store.manifest()["base"]["chunks"]
    # A first load becomes the base as it was written.
    assert len(before) == 8 and len(store._names("data")) == 1
    store.replace({"chunks": rows(spark, [(5, "new", 0), (5, "new", 1)])})
    state = store.manifest()
    named = [*state["base"]["chunks"].values(), *[f for c in state["changes"] for f in (c["keys"], *c["tables"].values())]]
    assert all(any(f"/{n}/" in f for n in named) for f in store.table("chunks").inputFiles())
    store.compact()
    after = store.manifest()["base"]["chunks"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert content(store) == sorted([(k, "base", 0) for k in range(64) if k != 5] + [(5, "new", 0), (5, "new", 1)])


def test_one_change_over_old_and_new_buckets(spark, tmp_path):
    store = Snapshot(spark, str(tmp_path), "doc_id", buckets=8)
    store.replace({"chunks": rows(spark, [(1, "base", 0), (2, "base", 0)])})
    store.compact()
    old = store.manifest()["base"]["chunks"]
    store.replace({"chunks": rows(spark, [(k, "new", 0) for k in (1, *range(10, 30))])}, spark.createDataFrame([(2,)], "doc_id bigint"))
    store.compact()
    new = store.manifest()["base"]["chunks"]
    assert len(new) == 8 and len({f.split("/")[1] for f in new.values()}) == 2 and not set(old.values()) & set(new.values())
    assert content(store) == [(k, "new", 0) for k in (1, *range(10, 30))]


def test_names_null_keys_and_empty_tables(spark, tmp_path):
    store = Snapshot(spark, str(tmp_path), "doc_id", buckets=4)
    store.replace_by("name", {"documents": rows(spark, [(1, "a", 0), (2, "b", 0), (3, "a", 0), (None, "n", 0), (4, None, 0)])}, "documents")
    store.replace_by("name", {"documents": rows(spark, [(9, "a", 1), (None, "n", 1), (5, None, 0)])}, "documents")
    want = sorted([(2, "b", 0), (9, "a", 1), (4, None, 0), (5, None, 0), (None, "n", 0), (None, "n", 1)], key=str)
    assert sorted(content_any(store), key=str) == want
    store.compact()
    assert sorted(content_any(store), key=str) == want
    store.replace({"documents": rows(spark, [])})
    store.delete(spark.createDataFrame([(2,), (77,)], "doc_id bigint"))
    store.compact()
    assert sorted(content_any(store), key=str) == [r for r in want if r[0] != 2]
    with pytest.raises(ValueError, match="columns of documents"):
        store.replace({"documents": spark.createDataFrame([(1, "x")], "doc_id bigint, title string")})


def content_any(store):
    return [tuple(r) for r in store.table("documents").collect()]
