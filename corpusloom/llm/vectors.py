"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

A rotation is three rounds of random signs and a Walsh-Hadamard transform.  The hash of a rotated vector is
the signed coordinate axis nearest to it; a bucket is made of ``K`` such hashes, and ``K`` grows with the
logarithm of the number of vectors, so that unrelated vectors seldom share one.  Each of ``TABLES`` tables
files a vector under its own bucket and also looks into the ``PROBES`` buckets that are nearest to missing
it.  Two vectors meet where one's own bucket is among the other's.  Every pair that meets is verified by
its cosine in double precision.

Only bucket numbers are dealt out at first; vectors follow for buckets that at least two share, once for
each part of the work.  Buckets beyond ``BLOCK`` members are cut into blocks, and each pair of blocks is a
task of its own, so that no bucket is one task and none is capped.  Tasks return numbers of links by vector
and a spanning forest, never pairs.  A pair that meets in several buckets counts in the first of them.

Equal vectors are one node (keyed by a 64-bit hash) and are counted by their number.
Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing.
Vectors of different lengths do not link.  Null ids are counted as others; a component's id ignores them.
Repeated rows are vectors of their own.  Other columns, labels among them, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import spread
from corpusloom.llm.components import Forest, components
from corpusloom.session import materialize

MIN_COSINE = 0.95
TABLES = 10
PROBES = 8
#: Members of a bucket that one task compares with each other or with as many others.
BLOCK = 4096
#: Rows of a cosine matrix made at once.
STRIPE = 512
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, scaled to keep lengths; a power of two of columns."""
    n, size, half = len(x), x.shape[1], 1
    while half < size:
        x = x.reshape(n, -1, 2, half)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2)
        half *= 2
    return x.reshape(n, size) / math.sqrt(size)


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        x = hadamard(x * s)
    return x


def padded(x: np.ndarray) -> np.ndarray:
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, size - x.shape[1])))


def hashes_for(rows: int, dim: int) -> int:
    """Cross-polytope hashes in a bucket: enough that the buckets outnumber the vectors four times."""
    axes = 2 << max(1, (dim - 1).bit_length())
    return max(1, math.ceil(math.log(max(4 * rows, 2)) / math.log(axes)))


def buckets(unit: np.ndarray, k: int, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers, (vector, table, 1 + probes): first the own bucket, then the nearest others."""
    x = padded(unit)
    n, size = x.shape
    signs = np.random.default_rng(SEED).choice((-1.0, 1.0), (tables, k, 3, size))
    ranks = min(3, size)
    out = np.empty((n, tables, 1 + probes), np.uint64)
    # ways to miss: another axis in one place, or the second axis in two places
    ways = [[(i, r)] for i in range(k) for r in range(1, ranks)] + [[(i, 1), (j, 1)] for i in range(k) for j in range(i)]
    for t in range(tables):
        axes, heights = np.empty((n, k, ranks), np.uint64), np.empty((n, k, ranks))
        for i in range(k):
            y = rotate(x, signs[t, i])
            order = np.argpartition(-np.abs(y), ranks - 1, axis=1)[:, :ranks]
            top = np.take_along_axis(np.abs(y), order, axis=1)
            order = np.take_along_axis(order, np.argsort(-top, axis=1), axis=1)
            y = np.take_along_axis(y, order, axis=1)
            axes[:, i], heights[:, i] = 2 * order + (y < 0), np.abs(y)

        def number(chosen: np.ndarray) -> np.ndarray:
            key = np.full(n, t * 1_000_003 + unit.shape[1], np.uint64)
            for i in range(k):
                key = spread(key + chosen[:, i] + np.uint64(1))
            return key

        own = axes[:, :, 0]
        loss = np.stack([sum(heights[:, i, 0] - heights[:, i, r] for i, r in way) for way in ways], axis=1)
        keys = np.empty((n, len(ways)), np.uint64)
        for w, way in enumerate(ways):
            chosen = own.copy()
            for i, r in way:
                chosen[:, i] = axes[:, i, r]
            keys[:, w] = number(chosen)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = number(own)
        near = np.take_along_axis(keys, best, axis=1)
        out[:, t, 1 : 1 + near.shape[1]] = near
        out[:, t, 1 + near.shape[1] :] = out[:, t, :1]
    return out


def unit_rows(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(vectors), -1) if len(vectors) else np.empty((0, 2))
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    lengths = pa.compute.list_value_length(batch.column("vector"))
    for length in pa.compute.unique(lengths).to_pylist():
        yield batch.filter(pa.compute.equal(lengths, length))


def meetings(nodes: DataFrame, k: int, tables: int, probes: int) -> DataFrame:
    """bucket, own (whether it is the node's own bucket), node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_length(whole):
                for start in range(0, batch.num_rows, 1000):
                    some = batch.slice(start, 1000)
                    keys = buckets(unit_rows(some.column("vector")), k, tables, probes)
                    own = np.zeros(keys.shape, bool)
                    own[:, :, 0] = True
                    ids = np.repeat(some.column("node").to_numpy(), tables * (1 + probes))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(own.reshape(-1)), pa.array(ids)], ["bucket", "own", "node"])

    rows = nodes.select("node", "vector").mapInArrow(run, "bucket long, own boolean, node long")
    return rows.groupBy("bucket", "node").agg(F.max("own").alias("own"))


def compare(tasks: DataFrame, nodes: DataFrame, k: int, tables: int, probes: int, min_cosine: float) -> DataFrame:
    """(a, null, links) for each node of a task, and (a, b, null) of its spanning forest.

    ``tasks``: part, bucket, left, right, block, own, node.  Members of block ``left`` meet those of block
    ``right`` of the same bucket.
    """
    held = tasks.select("part", "node").distinct().join(nodes, "node")
    null = lambda kind: F.lit(None).cast(kind)
    both = tasks.select("part", "bucket", "left", "right", "block", "own", "node", null("array<double>").alias("vector"), null("long").alias("copies")).unionByName(
        held.select("part", null("long").alias("bucket"), null("int").alias("left"), null("int").alias("right"), null("int").alias("block"), null("boolean").alias("own"), "node", F.col("vector").cast("array<double>").alias("vector"), "copies")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: dict[int, np.ndarray] = {}
        signature: dict[int, np.ndarray] = {}
        copies: dict[int, int] = {}
        members: dict[tuple, list] = {}
        for whole in batches:
            is_node = np.asarray(whole.column("bucket").is_null())
            for batch in by_length(whole.filter(pa.array(is_node))):
                unit = unit_rows(batch.column("vector"))
                keys = buckets(unit, k, tables, probes)
                for i, (node, n) in enumerate(zip(batch.column("node").to_pylist(), batch.column("copies").to_pylist())):
                    units[node], signature[node], copies[node] = unit[i], keys[i], n
            rest = whole.filter(pa.array(~is_node))
            for bucket, left, right, block, own, node in zip(*(rest.column(c).to_pylist() for c in ("bucket", "left", "right", "block", "own", "node"))):
                members.setdefault((bucket, left, right), []).append((block, own, node))
        place = {node: i for i, node in enumerate(units)}
        links, forest = dict.fromkeys(units, 0), Forest()
        for (bucket, left, right), rows in members.items():
            key = np.int64(bucket).view(np.uint64)
            a = [r for r in rows if r[0] == left]
            b = a if left == right else [r for r in rows if r[0] == right]
            if not a or not b:
                continue
            matrix, own_b = np.stack([units[n] for _, _, n in b]), np.array([own for _, own, _ in b])
            signs_b, many_b, at_b = np.stack([signature[n] for _, _, n in b]), np.array([copies[n] for _, _, n in b]), np.array([place[n] for _, _, n in b])
            for start in range(0, len(a), STRIPE):
                some = a[start : start + STRIPE]
                cosine = np.stack([units[n] for _, _, n in some]) @ matrix.T
                fits = (cosine >= min_cosine) & (np.array([own for _, own, _ in some])[:, None] | own_b[None, :])
                if left == right:
                    fits &= np.array([place[n] for _, _, n in some])[:, None] < at_b[None, :]
                i, j = np.nonzero(fits)
                signs_a = np.stack([signature[n] for _, _, n in some])
                for cut in range(0, len(i), 20_000):
                    p, q = i[cut : cut + 20_000], j[cut : cut + 20_000]
                    first = first_meeting(signs_a[p], signs_b[q]) == key
                    p, q = p[first], q[first]
                    to_a = np.bincount(p, weights=many_b[q], minlength=len(some)).astype(np.int64)
                    to_b = np.bincount(q, weights=np.array([copies[n] for _, _, n in some])[p], minlength=len(b)).astype(np.int64)
                    for x in np.flatnonzero(to_a).tolist():
                        links[some[x][2]] += int(to_a[x])
                    for x in np.flatnonzero(to_b).tolist():
                        links[b[x][2]] += int(to_b[x])
                    for x, y in zip(p.tolist(), q.tolist()):
                        forest.join(some[x][2], b[y][2])
        found = [(node, n) for node, n in links.items() if n]
        edges = [(x, forest.root(x)) for x in list(forest.up)]
        edges = [e for e in edges if e[0] != e[1]]
        columns = [[x for x, _ in found] + [x for x, _ in edges], [None] * len(found) + [y for _, y in edges], [n for _, n in found] + [None] * len(edges)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "links"])

    return both.repartition("part").mapInArrow(run, "a long, b long, links long")


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first bucket, by table and then by number, in which pairs meet; a and b are (pair, table, bucket)."""
    out, open_ = np.zeros(len(a), np.uint64), np.ones(len(a), bool)
    last = np.uint64(0xFFFFFFFFFFFFFFFF)
    for t in range(a.shape[1]):
        own_a, own_b = a[:, t, 0], b[:, t, 0]
        via_a = np.where((b[:, t] == own_a[:, None]).any(axis=1), own_a, last)
        via_b = np.where((a[:, t] == own_b[:, None]).any(axis=1), own_b, last)
        least = np.minimum(via_a, via_b)
        met = open_ & (least != last)
        out[met] = least[met]
        open_ &= ~met
    return out


def similar_vectors(table: DataFrame, min_cosine: float = MIN_COSINE, tables: int = TABLES, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, n_links, component_id, kept of each row of ``table``."""
    vector = F.col(vector_col)
    limit = F.lit(float("inf"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists(vector, lambda x: x != 0)
    # adding zero makes one value of both zeros
    plain = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))
    rows = materialize(table.select(F.col(id_col).alias("id"), F.when(sound, plain).alias("vector")).withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))), "vectors")
    nodes = materialize(rows.where("node is not null").groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("copies")), "nodes")
    shape = nodes.agg(F.count("*"), F.max(F.size("vector"))).first()
    k = hashes_for(shape[0], shape[1] or 2)
    filed = materialize(meetings(nodes, k, tables, probes), "buckets")
    shared = filed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("own").alias("any")).where("n > 1 and any").select("bucket", "n")
    joined = filed.join(shared, "bucket")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = joined.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    # block x meets blocks 0 to blocks - 1, the smaller number always on the left
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, shape[0] // 20_000)
    tasks = dealt.select("bucket", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "own", "node")
    tasks = materialize(tasks.withColumn("part", F.pmod(F.xxhash64("bucket", "left", "right"), F.lit(parts)).cast("int")), "tasks")
    found = materialize(compare(tasks, nodes, k, tables, probes, min_cosine), "found")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(found.where("b is not null").select("a", "b"))
    known = nodes.select("node", "copies").join(links, "node", "left").join(labels, "node", "left")
    known = known.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    every = rows.select("id", "node").join(known, "node", "left")
    ids = every.where("component is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    out = every.join(ids, "component", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
