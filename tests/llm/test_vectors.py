import numpy as np
import pytest

from corpusloom.llm import vectors


def brute(rows):
    sound = [i for i, (_, v, _) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in sound:
        for j in sound:
            a, b = (np.array(rows[x][1]) / max(map(abs, rows[x][1])) for x in (i, j))
            if i != j and len(a) == len(b) and a @ b >= 0.95 * np.linalg.norm(a) * np.linalg.norm(b):
                links[i].add(j)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        top = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec_id, len(links[i]), top, vec_id is not None and vec_id == top))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [4096, 7])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = []
    for _ in range(60):
        base = rng.normal(size=24)
        for _ in range(int(rng.choice((1, 1, 2, 5)))):
            rows.append((len(rows), (base + rng.normal(size=24) * 0.05).tolist(), 1))
    hot = rng.normal(size=24)
    rows += [(1000 + i, (hot + rng.normal(size=24) * rng.choice((0.05, 0.2))).tolist(), 2) for i in range(60)]
    rows += [(2000 + i, hot.tolist(), 3) for i in range(9)] + [(3000, (hot * 1e200).tolist(), 0), (3001, (hot * 1e-200).tolist(), 0)]
    rows += [(5000, None, 0), (5001, [], 0), (5002, [0.0] * 24, 0), (5003, [float("nan")] * 24, 0), (5004, [float("inf"), *hot[1:].tolist()], 0)]
    rows += [(5005, [None, *hot[1:].tolist()], 0), (5006, [1.0, 2.0, 3.0], 0), (5007, [2.0, 4.0, 6.0], 0), (None, [2.0, 4.0, 6.1], 0), (None, None, 0), (7, rows[7][1], 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int").repartition(3)
    assert sorted((tuple(r) for r in vectors.similar_vectors(table).collect()), key=str) == brute(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    for rows in (500, 50_000, 5_000_000):
        k = vectors.hashes_for(rows, 64)
        x, y = vectors.buckets(a, k), vectors.buckets(b, k)
        met = (vectors.first_meeting(x, y) != 0).mean()
        assert met > 0.995


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = vectors.rotate(x, np.ones((3, 16)))
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))


def test_empty_table(spark):
    assert vectors.similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
