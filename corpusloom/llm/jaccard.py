"""Similarity join of documents by the Jaccard index of their word shingles, through count vectors.

A document's set holds the hashes of its distinct five-word shingles.  Shingles are also hashed into
groups; the numbers of a document's shingles by group are its point.  Two sets share at most the sum over
groups of the smaller count.  Points are kept in R-trees (``CountTree``): a node bounds its points by the
largest count of each group and their range of sizes, so whole nodes are passed over when even the bound
is too small.  What the bound leaves is verified on the sets.

Points of unrelated documents have no locality that one tree over all of them could use: an R-tree node of
unrelated points bounds nothing (README has the argument).  So the trees are built for the documents that
share a token.  Of the sorted hashes of a set of n, the first n - ceil(0.75 n) + 1 + ``SLACK`` are listed as its
tokens: two linked sets have at least ``least`` = min(1 + SLACK, ceil(0.75 n)) of them in common, for the n
of either.  Tokens are dealt out as packed blocks; those that no two documents of fitting sizes have go at once, and then
the documents with fewer than ``least`` tokens left.  A document with fewer than that many tokens of more
than ``HOT`` documents meets all its partners in the other tokens, and leaves the hot ones.

Links are found in steps.  First, documents that share one of their ``SEEDS`` smallest hashes are tied, each to
the middle of its neighbourhood, and verified.  Nearly all copies are one component then, and whatever lies inside a
component needs no further work.  Of the rest, tokens of up to ``SMALL`` documents give pairs that are counted over
all tokens: less than ``least`` is no link.  Linked sets without such a token share ``least`` larger ones, so each
document leaves its ``least`` - 1 most common of them, and two documents meet in the first that both have left only.
There a few pairs with each larger component are tried, and only then, pairs that still lie in different
components are enumerated.  Groups are not expanded into all pairs.

Equal sets are one node from the start (its key is a 64-bit hash of the set; shingles are 64-bit hashes).
Defined cases: texts with fewer than five words have their whole word sequence as one shingle; null texts
and texts without words have no set and are linked with nothing.  A component's id ignores null document
ids and is null if there are no others.  Rows with equal ids are separate documents.  Other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import deal, pack, partitions_for, spread
from corpusloom.llm.components import components
from corpusloom.session import materialize

WORDS = 5
#: Smallest similarity, in percent.
PERCENT = 75
HOT = 16
SLACK = 32
SMALL = 16
#: Smallest hashes of a set that the first ties are made by, and documents tied at once.
SEEDS = 4
TIED = 256
FEW = 3
#: Points of an R-tree leaf, and children of an inner node.
PAGE = 128
CHILDREN = 16
#: Cells of a matrix that a task holds of a group's tokens or pairs.
CELLS = 1 << 22
FINE_GROUPS = 256
MAX_GROUPS = 4096
SHARDS_EACH = 8
PARTS_EACH = 4
DOCS_AT_ONCE = 4096
#: Bits of the filter that says whose texts are read again; it is broadcast and takes 1 MB at most.
FILTER_BITS = 1 << 23
BITMAP = 1 << 15

#: ``n`` is the size of the set, with the highest bit set for a seed.
TOKEN = np.dtype([("token", "<u4"), ("node", "<u8"), ("n", "<u4")])
SEED = np.uint32(1 << 31)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    split = (text or "").encode().lower().split()
    if not split:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, split)), np.uint64)
    k = min(words, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += h[i : len(h) - k + 1 + i]
    total = spread(total)
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


def needed(n: int, m: int, percent: int = PERCENT) -> int:
    """Smallest overlap of sets of n and m whose similarity reaches ``percent``."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def group_counts(hashes: np.ndarray) -> bytes:
    """Counts by group, one byte each; a power of two of groups.

    Small sets get more groups than shingles, as many of them share most of a passage and only a fine point
    tells them apart; large ones half as many or more.  Empty if a count doesn't fit: such a point bounds
    nothing.
    """
    n, groups = len(hashes), 8
    while groups < min(2 * n, FINE_GROUPS) or groups < n / 2 and groups < MAX_GROUPS:
        groups *= 2
    counts = np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    return point.reshape(-1, groups).sum(axis=0) if len(point) > groups else point


def may_link(n: int, p: np.ndarray, m: int, q: np.ndarray, percent: int) -> bool:
    if min(n, m) * 100 < percent * max(n, m):
        return False
    if not len(p) or not len(q):
        return True
    groups = min(len(p), len(q))
    return int(np.minimum(folded(p, groups), folded(q, groups)).sum()) >= needed(n, m, percent)


def allowed(sizes: np.ndarray, points: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of the pairs that the bound allows, for the points of one leaf."""
    ok = 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
    groups = np.array([len(p) for p in points])
    for g in np.unique(groups[groups > 0]).tolist():
        one = np.flatnonzero(groups == g)
        mine = np.stack([points[i] for i in one])
        for h in (g, g // 2):
            other = np.flatnonzero(groups == h)
            if not h or not len(other):
                continue
            theirs = np.stack([points[i] for i in other]).astype(np.uint16)
            rows = mine.reshape(len(one), -1, h).sum(axis=1, dtype=np.uint16)
            step = max(1, (1 << 20) // (len(other) * h))
            for start in range(0, len(one), step):
                i = one[start : start + step]
                share = np.minimum(rows[start : start + step, None, :], theirs[None]).sum(axis=2, dtype=np.int64)
                fits = (100 + percent) * share >= percent * np.add.outer(sizes[i], sizes[other])
                ok[np.ix_(i, other)] &= fits
                if h != g:
                    ok[np.ix_(other, i)] &= fits.T
    np.fill_diagonal(ok, False)
    return ok


class CountTree:
    """R-tree over points of group counts, bulk-loaded by number of groups, size and the first groups' counts.

    Points of up to one page are a single leaf, whose allowed pairs are found at once.
    """

    def __init__(self, sizes: np.ndarray, points: list[np.ndarray], percent: int = PERCENT):
        self.sizes, self.points, self.percent = sizes, points, percent
        self.matrix = allowed(sizes, points, percent) if len(points) <= PAGE else None
        if self.matrix is not None:
            return
        groups = np.array([len(p) for p in points])
        first = np.array([[int(x) for x in folded(p, 8)[:2]] if len(p) else [0, 0] for p in points])
        order = np.lexsort((first[:, 1], first[:, 0], sizes, groups))
        cuts = np.flatnonzero(np.diff(groups[order])) + 1
        pages = [part[i : i + PAGE] for part in np.split(order, cuts) for i in range(0, len(part), PAGE)]
        self.top = [self.leaf(p) for p in pages]
        while len(self.top) > CHILDREN:
            self.top = [self.over(self.top[i : i + CHILDREN]) for i in range(0, len(self.top), CHILDREN)]

    def leaf(self, members: np.ndarray) -> tuple:
        points = [self.points[i] for i in members]
        matrix = np.stack(points).astype(np.uint16) if len(points[0]) else None
        largest = None if matrix is None else matrix.max(axis=0)
        return int(self.sizes[members].min()), int(self.sizes[members].max()), largest, members, matrix

    @staticmethod
    def over(children: list[tuple]) -> tuple:
        tops, top = [c[2] for c in children], None
        if all(t is not None for t in tops):
            groups = min(map(len, tops))
            top = np.stack([folded(t, groups) for t in tops]).max(axis=0)
        return min(c[0] for c in children), max(c[1] for c in children), top, children, None

    def near(self, i: int, among: np.ndarray | None = None) -> np.ndarray:
        """Places of all other points, or of those that ``among`` marks, that may reach the similarity with point i."""
        if self.matrix is not None:
            return np.flatnonzero(self.matrix[i] if among is None else self.matrix[i] & among)
        found = self.search(int(self.sizes[i]), self.points[i], among)
        return found[found != i]

    def search(self, n: int, point: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        found, todo, percent = [], list(self.top), self.percent
        while todo:
            low, high, top, inside, matrix = todo.pop()
            if 100 * high < percent * n or 100 * n < percent * low:
                continue
            bounded = top is not None and len(point)
            if bounded:
                groups = min(len(top), len(point))
                if int(np.minimum(folded(top, groups), folded(point, groups)).sum(dtype=np.int64)) < needed(n, max(low, -(-percent * n // 100)), percent):
                    continue
            if isinstance(inside, list):
                todo.extend(inside)
                continue
            sizes = self.sizes[inside]
            fits = 100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)
            if among is not None:
                fits &= among[inside]
            if bounded and fits.any():
                inside, sizes, rows = inside[fits], sizes[fits], matrix[fits]
                groups = min(rows.shape[1], len(point))
                rows = rows if rows.shape[1] == groups else rows.reshape(len(rows), -1, groups).sum(axis=1)
                fits = (100 + percent) * np.minimum(rows, folded(point, groups)).sum(axis=1, dtype=np.int64) >= percent * (sizes + n)
            found.append(inside[fits])
        return np.concatenate(found) if found else np.empty(0, np.int64)


def met_before(lists: list[np.ndarray], token: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows, some at a time, of the matrix of those members of a token's group that share a smaller token as well.

    ``lists`` has the sorted tokens of each member.  The tokens that most members have are multiplied as a matrix.
    """
    size = len(lists)
    lists = [x[: np.searchsorted(x, token)] for x in lists]
    owner = np.repeat(np.arange(size), [len(x) for x in lists])
    _, column, holders = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    rank = np.argsort(np.argsort(-holders, kind="stable"))  # of the columns, the most common first
    wide = min(int((holders > 1).sum()), CELLS // size)
    held = np.zeros((size, wide), np.float32)
    dense = rank[column] < wide
    held[owner[dense], rank[column[dense]]] = 1
    rest = ~dense & (holders[column] > 1)
    owner, column = owner[rest], column[rest]
    order = np.argsort(column, kind="stable")
    members, of = owner[order], column[order]  # owners of each other column side by side
    step = max(1, CELLS // size)
    for start in range(0, size, step):
        met = held[start : start + step] @ held.T > 0
        some = np.flatnonzero((owner >= start) & (owner < start + step))
        low, high = np.searchsorted(of, column[some]), np.searchsorted(of, column[some], "right")
        for i, x, y in zip((owner[some] - start).tolist(), low.tolist(), high.tolist()):
            met[i, members[x:y]] = True
        yield start, met


def tie(sizes: np.ndarray, points: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs that tie every point to the middle of its neighbourhood, breadth first over what the bound allows."""
    tree, fresh, pairs = CountTree(sizes, points, percent), np.ones(len(points), bool), []
    if tree.matrix is not None and not tree.matrix.any():
        return []
    for start in range(len(points)):
        todo = [start] if fresh[start] else []
        while todo:
            i = todo.pop()
            fresh[i] = False
            near = tree.near(i)
            near = near[fresh[near]]
            if not len(near):
                continue
            some = [j for j in near if len(points[j])]
            centre = i
            if len(some) > 2:
                groups = min(len(points[j]) for j in some)
                matrix = np.stack([folded(points[j], groups) for j in some]).astype(np.int32)
                centre = int(some[int(np.abs(matrix - np.median(matrix, axis=0)).sum(axis=1).argmin())])
            fresh[near] = False
            pairs += [(i, centre)] if centre != i else []
            pairs += [(centre, int(j)) for j in near if j != centre]
            todo += [int(j) for j in near]
    return pairs


def scan(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Documents and their tokens, from one pass over the texts.

    Rows without a token are documents: doc_id, node (key of the set; null without one), n (its size), point.  The
    others are tokens that at least two sets of fitting sizes have: part, token, node, n, seed, count.
    """
    partitions = partitions_for(docs)
    shards, parts, slack, seeds = partitions * SHARDS_EACH, partitions * PARTS_EACH, SLACK, SEEDS
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for start in range(0, whole.num_rows, DOCS_AT_ONCE):
                batch = whole.slice(start, DOCS_AT_ONCE)
                sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
                nodes, sizes = np.array([set_key(s) for s in sets], np.uint64), np.array([len(s) for s in sets], np.int64)
                fresh = []
                for i, (node, n) in enumerate(zip(nodes.tolist(), sizes.tolist())):
                    if n and node not in seen:  # copies within a task go here; all others in the next step
                        fresh.append(i)
                        if len(seen) < 200_000:
                            seen.add(node)
                ids, points = batch.column("doc_id"), pa.array([group_counts(s) for s in sets], pa.binary())
                shard = pa.array(np.arange(start, start + len(sets)) % shards, pa.int32())
                yield pa.RecordBatch.from_arrays([shard, pa.nulls(len(sets), pa.binary()), ids, pa.array(nodes.view(np.int64), mask=sizes == 0), pa.array(sizes), points], names)
                if fresh:
                    tokens = [sets[i][: prefix_length(len(sets[i]), percent) + slack] for i in fresh]
                    lengths = np.array([len(t) for t in tokens])
                    mixed = spread(np.concatenate(tokens))
                    rows = np.empty(len(mixed), TOKEN)
                    rows["token"], rows["node"] = mixed & np.uint64(0xFFFFFFFF), np.repeat(nodes[fresh], lengths)
                    rows["n"] = np.repeat(sizes[fresh], lengths)
                    place = np.arange(len(mixed)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    rows["n"][place < seeds] |= SEED
                    packed = pack((((mixed >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64), rows)
                    k = packed.num_rows
                    yield pa.RecordBatch.from_arrays([*packed.columns, pa.nulls(k, ids.type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_shard: dict[int, list[np.ndarray]] = {}
        kind = None
        for batch in batches:
            is_doc = np.asarray(batch.column("block").is_null())
            found, kind = batch.filter(pa.array(is_doc)), batch.column("doc_id").type
            none = lambda t: pa.nulls(found.num_rows, t)
            yield pa.RecordBatch.from_arrays([none(pa.int32()), none(pa.int64()), *(found.column(x) for x in ("node", "n")), none(pa.bool_()), none(pa.int64()), *(found.column(x) for x in ("doc_id", "point"))], out)
            packed = batch.filter(pa.array(~is_doc))
            for shard, block in zip(packed.column("shard").to_pylist(), packed.column("block")):
                by_shard.setdefault(shard, []).append(np.frombuffer(block.as_py(), TOKEN))
        while by_shard:
            shard, blocks = by_shard.popitem()
            rows = np.concatenate(blocks)
            size = (rows["n"] & ~SEED).astype(np.int64)
            order = np.lexsort((rows["node"], size, rows["token"]))
            rows, size = rows[order], size[order]
            first = np.concatenate(([True], (rows["token"][1:] != rows["token"][:-1]) | (rows["node"][1:] != rows["node"][:-1])))
            rows, size = rows[first], size[first]
            # in order of size, a set that fits any other of its token fits the one beside it
            fits = (rows["token"][1:] == rows["token"][:-1]) & (100 * size[:-1] >= percent * size[1:])
            keep = np.concatenate(([False], fits)) | np.concatenate((fits, [False]))
            rows, size = rows[keep], size[keep]
            starts = np.flatnonzero(np.concatenate(([True], rows["token"][1:] != rows["token"][:-1]))) if len(rows) else np.empty(0, np.int64)
            counts = np.diff(np.concatenate((starts, [len(rows)])))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows), shard % parts, np.int32)),
                    pa.array(rows["token"].astype(np.int64) + (np.int64(shard) << np.int64(32))),
                    pa.array(rows["node"].view(np.int64)) if len(rows) == 0 else pa.array(np.ascontiguousarray(rows["node"]).view(np.int64)),
                    pa.array(size),
                    pa.array((rows["n"] & SEED) > 0),
                    pa.array(np.repeat(counts, counts).astype(np.int64)),
                    pa.nulls(len(rows), kind),
                    pa.nulls(len(rows), pa.binary()),
                ],
                out,
            )

    names, out = ["shard", "block", "doc_id", "node", "n", "point"], ["part", "token", "node", "n", "seed", "count", "doc_id", "point"]
    blocks = docs.select("doc_id", "text").mapInArrow(emit, f"shard int, block binary, doc_id {id_type}, node long, n long, point binary")
    return deal(blocks, partitions).mapInArrow(meet, f"part int, token long, node long, n long, seed boolean, count long, doc_id {id_type}, point binary")


def with_components(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def open_tokens(tokens: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Tokens that links between components can still be found by, with least (tokens that the node shares with any
    partner), large (its tokens of more than ``SMALL`` documents) and component."""
    node = Window.partitionBy("node")
    most = lambda limit: F.count(F.when(F.col("count") > limit, True)).over(node)
    least = F.least(F.lit(1 + SLACK), F.ceil(F.col("n") * percent / 100)).cast("long")
    counted = with_components(tokens.drop("seed"), labels).select("*", least.alias("least"), F.count("*").over(node).alias("listed"), most(SMALL).alias("large"), most(HOT).alias("hot"))
    some = counted.where((F.col("listed") >= F.col("least")) & ((F.col("count") <= HOT) | (F.col("hot") >= F.col("least"))))
    return some.drop("listed", "hot")


def counted_pairs(tokens: DataFrame, points: DataFrame, percent: int, partitions: int) -> DataFrame:
    """Pairs of different components that share enough tokens of small groups and that the bound allows."""
    small = SMALL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "node", "n", "component", "least", "large")
        held = [np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in names]) for batch in batches if batch.num_rows]
        if not held:
            return
        rows = np.concatenate(held, axis=1)
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        found = []
        for step in range(1, min(small, rows.shape[1])):
            i = np.flatnonzero(rows[0][step:] == rows[0][:-step])
            x, y = rows[:, i], rows[:, i + step]
            some = (x[3] != y[3]) & (100 * np.minimum(x[2], y[2]) >= percent * np.maximum(x[2], y[2]))
            x, y = x[:, some], y[:, some]
            needs = np.maximum(1, np.maximum(x[4], y[4]) - np.minimum(x[5], y[5]))
            found.append(np.stack([np.minimum(x[1], y[1]), np.maximum(x[1], y[1]), needs]))
        pairs = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
        pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
        new = np.concatenate(([True], (pairs[0][1:] != pairs[0][:-1]) | (pairs[1][1:] != pairs[1][:-1]))) if pairs.shape[1] else np.empty(0, bool)
        starts = np.flatnonzero(new)
        shared = np.diff(np.concatenate((starts, [pairs.shape[1]])))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*pairs[:, starts], shared)], ["a", "b", "needs", "shared"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = ([np.frombuffer(x.as_py(), np.uint8) for x in batch.column(c)] for c in ("p", "q"))
            fits = [may_link(n, x, m, y, percent) for n, x, m, y in zip(batch.column("na").to_pylist(), p, batch.column("nb").to_pylist(), q)]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    rows = tokens.where(F.col("count") <= SMALL).repartition(partitions, "part").select("token", "node", "n", "component", "least", "large")
    pairs = rows.mapInArrow(run, "a long, b long, needs long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("needs").alias("needs"))
    pairs = materialize(pairs.where("shared >= needs").select("a", "b"), "counted")
    left = pairs.join(points.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("point").alias("p")), "a")
    return left.join(points.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("point").alias("q")), "b").mapInArrow(bound, "a long, b long")


def first_tokens(tokens: DataFrame) -> DataFrame:
    """Node, its ``kept`` tokens (part, token) and their sorted ``list``: of the tokens of large groups all but the
    ``least`` - 1 of the most documents.  Two linked nodes that share no token of a small group both keep one of them."""
    large = tokens.where((F.col("count") > SMALL) & (F.col("large") >= F.col("least")))
    ordered = F.sort_array(F.collect_list(F.struct("count", "token", "part"))).alias("all")
    some = large.groupBy("node").agg(ordered, F.first(F.col("large") - F.col("least") + 1).cast("int").alias("first"))
    kept = some.select("node", F.expr("transform(slice(all, 1, first), x -> struct(x.part as part, x.token as token))").alias("kept"))
    return kept.withColumn("list", F.sort_array("kept.token"))


def tree_pairs(rows: DataFrame, points: DataFrame, percent: int, partitions: int, few: int | None = None) -> DataFrame:
    """Pairs (a, b) of nodes that the bound allows, of the groups that share a token of those in ``kept``.

    Without ``few``: all pairs of small groups, and ties of large ones.  Otherwise rows have a component and a list, pairs
    lie in different components and are those that have no smaller token in both lists: all of these, or of each document
    only ``few`` with each component that is larger in the group; a token whose group has more is a row (token, null).
    """
    second, small, tied = few is not None, SMALL, TIED
    rows = rows if second else rows.select("*", F.col("node").alias("component"), F.lit(None).cast("array<long>").alias("list"))
    empty = lambda kind: F.lit(None).cast(kind)
    nodes = rows.join(points, "node").select(F.explode(F.array_distinct("kept.part")).alias("part"), empty("long").alias("token"), "node", "n", "point", "component", "list")
    dealt = rows.select("node", F.explode("kept").alias("k")).select("k.part", "k.token", "node", empty("long").alias("n"), empty("binary").alias("point"), empty("long").alias("component"), empty("array<long>").alias("list"))
    both = dealt.unionByName(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, point, component, lists, held = {}, {}, {}, {}, []
        for batch in batches:
            is_node = np.asarray(batch.column("token").is_null())
            info = batch.filter(pa.array(is_node))
            for node, n, p, c, x in zip(*(info.column(x).to_pylist() for x in ("node", "n", "point", "component")), info.column("list")):
                size[node], point[node], component[node] = n, np.frombuffer(p, np.uint8), c
                if second:
                    lists[node] = x.values.to_numpy()
            rest = batch.filter(pa.array(~is_node))
            held.append(np.stack([rest.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("token", "node")], axis=1))
        table = np.concatenate(held) if held else np.empty((0, 2), np.int64)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        starts = np.flatnonzero(np.concatenate(([True], table[1:, 0] != table[:-1, 0]))) if len(table) else []
        tried: set[tuple[int, int]] = set()
        out: list[tuple[int, int | None]] = []

        def offer(a: int, b: int) -> None:
            pair = (a, b) if a < b else (b, a)
            if pair not in tried:
                tried.add(pair)
                if may_link(size[a], point[a], size[b], point[b], percent):
                    out.append(pair)

        def first_meetings(token: int, group: list[int]) -> None:
            sizes, of = (np.array([x[node] for node in group], np.int64) for x in (size, component))
            ids, place, count = np.unique(of, return_inverse=True, return_counts=True)
            rank = np.argsort(np.lexsort((ids, count)))[place]  # pairs are found from the end in the smaller component
            tree, capped = None, False
            for start, met in met_before([lists[node] for node in group], token):
                part = slice(start, start + len(met))
                fits = 100 * np.minimum.outer(sizes[part], sizes) >= percent * np.maximum.outer(sizes[part], sizes)
                wanted = fits & ~met & (rank[part, None] < rank)
                for i in np.flatnonzero(wanted.any(axis=1)).tolist():
                    tree = tree or CountTree(sizes, [point[node] for node in group], percent)
                    near = tree.near(start + i, wanted[i])
                    if few:
                        near = near[np.argsort(of[near], kind="stable")]
                        new = np.flatnonzero(np.diff(of[near], prepend=of[near][:1] - 1))
                        taken = np.arange(len(near)) - np.repeat(new, np.diff(new, append=len(near))) < few
                        near, capped = near[taken], capped or not taken.all()
                    for j in near.tolist():
                        a, b = group[start + i], group[j]
                        out.append((a, b) if a < b else (b, a))
            if capped:
                out.append((token, None))

        for start, stop in zip(starts, [*starts[1:], len(table)]):
            group = table[start:stop, 1].tolist()
            if len({component[x] for x in group}) == 1:
                continue
            if second:
                first_meetings(int(table[start, 0]), group)
            elif len(group) <= small:
                for i, a in enumerate(group):
                    for b in group[i + 1 :]:
                        offer(a, b)
            else:
                group.sort(key=size.__getitem__)
                for k in range(0, len(group), tied):
                    some = group[k : k + tied]
                    for i, j in tie(np.array([size[x] for x in some], np.int64), [point[x] for x in some], percent):
                        offer(some[i], some[j])
                    if k:
                        offer(group[k - 1], group[k])
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    pairs = both.repartition(partitions, "part").mapInArrow(run, "a long, b long")
    return pairs if second else pairs.distinct()


def with_bit(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id may be in ``wanted``: a filter of a fixed size, broadcast; some others pass."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    place, number = (bit % BITMAP).alias("place"), F.floor(bit / BITMAP).cast("int").alias("number")
    bitmaps = wanted.select(place, number).groupBy("number").agg(F.bitmap_construct_agg("place").alias("bitmap"))
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = docs.select("*", place, number).join(F.broadcast(bitmaps), "number")
    return found.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(place % 8 as int))")) != 0).select(*docs.columns)


def verified(pairs: DataFrame, docs: DataFrame, summary: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose sets reach the similarity; sets are made of one document of each node in a pair."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = summary.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(nodes, "node").select("doc_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, DOCS_AT_ONCE) for b in batches for i in range(0, b.num_rows, DOCS_AT_ONCE)):
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            values = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            keys = np.array([set_key(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["node", "hashes"])

    some = materialize(some, "wanted")
    near = with_bit(docs.select("doc_id", "text"), some)
    wanted = near.join(some, near["doc_id"].eqNullSafe(some["doc_id"]), "left_semi")
    sets = materialize(wanted.select("text").mapInArrow(run, "node long, hashes array<long>").join(nodes, "node", "left_semi"), "sets")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    common = both.select("a", "b", (F.size("ha") + F.size("hb")).alias("sizes"), F.size(F.array_intersect("ha", "hb")).alias("common"))
    return common.where(100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))).select("a", "b")


def similarity_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``."""
    found = materialize(scan(docs, words, percent), "scan")
    summary = found.where("token is null").select("doc_id", "node", "n", "point")
    tokens = found.where("token is not null").select("part", "token", "node", "n", "seed", "count")
    points = materialize(summary.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("point").alias("point")), "points")
    partitions = partitions_for(docs)
    seeds = tokens.where("seed").groupBy("node").agg(F.collect_list(F.struct("part", "token")).alias("kept"))
    tried = materialize(tree_pairs(materialize(seeds, "seeds"), points, percent, partitions), "pairs")
    links = materialize(verified(tried, docs, summary, words, percent), "verified")
    labels = materialize(components(links), "labels")
    tokens = materialize(open_tokens(tokens, labels, percent), "tokens")
    large = materialize(first_tokens(tokens), "large")
    # what ties missed: counted pairs and a few with each larger component, then all that still differ
    some = materialize(tree_pairs(with_components(large, labels), points, percent, partitions, FEW), "few")
    capped = some.where("b is null").select(F.col("a").alias("token")).distinct()
    pairs = some.where("b is not null").union(counted_pairs(tokens, points, percent, partitions)).distinct()
    for last in (False, True):
        if last:
            if not capped.take(1):
                break
            left = large.select("node", F.explode("kept").alias("k")).join(capped, F.col("k.token") == capped["token"], "left_semi").groupBy("node").agg(F.collect_list("k").alias("kept"))
            pairs = tree_pairs(with_components(left.join(large.drop("kept"), "node"), labels), points, percent, partitions, 0)
        more = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if more.take(1):
            tried = tried.union(more)
            links = links.union(materialize(verified(more, docs, summary, words, percent), "verified"))
            labels = materialize(components(links), "labels")
    known = summary.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = known.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = known.join(ids, "component", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
