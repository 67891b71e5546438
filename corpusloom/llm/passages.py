"""Removal of passages that stand earlier in the corpus, by a family of sparse suffix arrays.

Every string of ``LENGTH`` bytes that also starts earlier (in a document of smaller id, or earlier in the
same one) is removed where it stands later; all is judged on the input.

Sampling.  Among the grams of ``GRAM`` bytes inside a string, the one with the smallest hash (the leftmost
of them) is its anchor.  Equal strings have equal anchors at equal places, so only suffixes that begin at
anchors are kept, about one in 35 bytes, each with its context: all strings it is the anchor of.

Index.  Suffixes are dealt out by the hash of their gram.  In each part, batches in document order get
their suffix array (sorted by gram, then by context), are merge-scanned against the existing levels, and
join them; levels of similar size merge, so a suffix is merged a logarithmic number of times
(``SuffixFamily``).  A suffix whose whole context stands earlier gives a span at once.  Where a gram stands
in different contexts, the matches end inside them: the contexts' bytes are fetched from the documents, and
their strings are compared one by one (in the same family of sorted levels, by the hash of the string).

Only the first of equal suffixes of a task is dealt out; the others are repeats for sure.  So a passage
that a third of all documents hold is one row for each task, not for each document; its ends, which differ,
are one row for each document.

Defined cases: a null text is empty; documents shorter than ``LENGTH`` bytes lose nothing.  Documents are
ordered by id, null last, and then by a hash of the text; rows that repeat both id and text are one
document, and none of them is earlier than the other.  An id of 2^63 - 1 counts as null.  Other columns are
not looked at.  Strings are compared by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import deal, pack, partitions_for, spread
from corpusloom.session import materialize

LENGTH = 100
GRAM = 32
#: Bytes of text hashed at once, suffixes in a batch of the index, contexts compared at once.
CHUNK = 1 << 19
BATCH = 1 << 16
CONTEXTS = 4096
SHARDS_EACH = 8
NO_ID = np.int64(2**63 - 1)

SUFFIX = np.dtype([("gram", "<u4"), ("context", "<u8"), ("doc", "<i8"), ("version", "<u4"), ("start", "<u4"), ("anchor", "u1"), ("more", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("version", "<u4"), ("start", "<u4"), ("stop", "<u4")])

BASE = 0x9E3779B97F4A7C15 | 1


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of all substrings of a byte array, from running sums of a polynomial modulo 2^64.

    (Such hashes fail on crafted strings of a thousand bytes and more; those compared here are shorter.)
    """

    def __init__(self, size: int):
        self.up, self.down = powers(BASE, size + 1), powers(pow(BASE, -1, 1 << 64), size + 1)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return spread((sums[stop] - sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    n, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n]) if span < width else x[:n]


def suffixes(texts: list[bytes], docs: np.ndarray, versions: np.ndarray, hashes: Hashes, length: int, gram: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(64-bit gram hash, suffix rows) of documents, chunk by chunk; a long document spans chunks."""
    pieces: list[tuple[int, int, bytes]] = []
    held = 0
    for i, text in enumerate([*texts, None]):
        if held and (text is None or held + len(text) > chunk):
            yield from chunk_suffixes(pieces, docs, versions, hashes, length, gram)
            pieces, held = [], 0
        if text is None or len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, chunk):
            piece = text[at : at + chunk + length - 1]
            pieces.append((i, at, piece))
            held += len(piece)
            if held >= chunk:
                yield from chunk_suffixes(pieces, docs, versions, hashes, length, gram)
                pieces, held = [], 0


def chunk_suffixes(pieces, docs, versions, hashes: Hashes, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    sums = hashes.sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = hashes.of(sums, at, at + gram)
    low = np.uint64((1 << 21) - 1)
    least = sliding_min((grams & ~low) | at.astype(np.uint64), length - gram + 1)
    place = (least & low).astype(np.int64)
    firsts = np.cumsum([0, *(len(p[2]) for p in pieces)])
    valid = np.ones(len(place), bool)
    for stop in firsts[1:-1]:
        valid[max(0, stop - length + 1) : stop] = False
    new = place[1:] != place[:-1]
    begins = np.flatnonzero(valid & np.concatenate(([True], new | ~valid[:-1])))
    ends = np.flatnonzero(valid & np.concatenate((new | ~valid[1:], [True])))
    own = np.searchsorted(firsts, begins, "right") - 1
    index, offset = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    rows = np.empty(len(begins), SUFFIX)
    found = grams[place[begins]]
    rows["gram"], rows["context"] = found & np.uint64(0xFFFFFFFF), hashes.of(sums, begins, ends + length)
    rows["doc"], rows["version"] = docs[index[own]], versions[index[own]]
    rows["start"], rows["anchor"], rows["more"] = begins - firsts[own] + offset[own], place[begins] - begins, ends - begins
    yield found, rows


def spans_of(rows: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(rows), SPAN)
    out["doc"], out["version"], out["start"] = rows["doc"], rows["version"], rows["start"]
    out["stop"] = rows["start"] + rows["more"] + np.uint32(length)
    return out


def united(spans: np.ndarray) -> np.ndarray:
    """Spans with those of a document that overlap or touch made one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["version"], spans["doc"]))]
    new = np.concatenate(([True], (spans["doc"][1:] != spans["doc"][:-1]) | (spans["version"][1:] != spans["version"][:-1])))
    group = np.cumsum(new).astype(np.int64) << np.int64(33)
    reach = np.maximum.accumulate(group + spans["stop"])
    cut = np.flatnonzero(np.concatenate(([True], group[1:] + spans["start"][1:] > reach[:-1])))
    out = spans[cut]
    out["stop"] = (reach - group)[np.concatenate((cut[1:], [len(spans)])) - 1]
    return out


def order_of(rows: np.ndarray, *keys: str) -> np.ndarray:
    return np.lexsort([rows[k] for k in reversed(keys)])


def run_starts(rows: np.ndarray, *keys: str) -> np.ndarray:
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= rows[k][1:] != rows[k][:-1]
    return new


class SuffixFamily:
    """Sorted levels of (key, detail) pairs; batches are scanned against them, join them, and levels of
    similar size merge.  ``seen`` says of each pair of a batch whether an earlier batch has it."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def seen(self, pairs: np.ndarray) -> np.ndarray:
        found = np.zeros(len(pairs), bool)
        for level in self.levels:
            at = np.searchsorted(level, pairs)
            found |= level[np.minimum(at, len(level) - 1)] == pairs
        return found

    def add(self, pairs: np.ndarray) -> None:
        level = np.unique(pairs)
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            level = np.union1d(self.levels.pop(), level)
        if len(level):
            self.levels.append(level)


def repeats(rows: np.ndarray, *keys: str, size: int = BATCH) -> np.ndarray:
    """Whether an earlier row (by document and start) has the same key, through the family of levels.

    Rows at the very place of the first one are no repeats.
    """
    key = spread(rows[keys[0]].astype(np.uint64))
    for k in keys[1:]:
        key = spread(key ^ rows[k].astype(np.uint64))
    order = order_of(rows, "doc", "version", "start")
    out, family, at = np.zeros(len(rows), bool), SuffixFamily(), 0
    new_place = run_starts(rows[order], "doc", "version", "start")
    while at < len(order):
        stop = min(at + size, len(order))
        while stop < len(order) and not new_place[stop]:
            stop += 1
        batch = order[at:stop]
        inside = batch[np.argsort(key[batch], kind="stable")]  # the batch's suffix array; document order within a key
        first = np.concatenate(([True], key[inside[1:]] != key[inside[:-1]]))
        head = inside[np.maximum.accumulate(np.where(first, np.arange(len(inside)), 0))]
        same_place = (rows["doc"][inside] == rows["doc"][head]) & (rows["version"][inside] == rows["version"][head]) & (rows["start"][inside] == rows["start"][head])
        out[inside] = ~same_place
        out[batch] |= family.seen(key[batch])
        family.add(key[batch])
        at = stop
    return out


def document_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    docs = batch.column("doc_id").cast(pa.int64()).fill_null(int(NO_ID)).to_numpy()
    return docs, batch.column("version").to_numpy().astype(np.uint32)


def _versioned(docs: DataFrame) -> DataFrame:
    """doc_id (null as the largest), version (32-bit hash of the text) and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc_id"), F.hash("text").alias("version"), F.coalesce("text", F.lit("")).alias("text"))


FOUND = "is_span boolean, doc_id long, version int, start long, stop long, anchor int, gram long"


def found_batch(spans: np.ndarray, asked: np.ndarray, grams: np.ndarray) -> pa.RecordBatch:
    """Spans, and contexts whose bytes are asked for, as rows."""
    n, m = len(spans), len(asked)
    both = lambda x, y, kind: pa.array(np.concatenate((x.astype(kind), y.astype(kind))))
    zero = np.zeros(n, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((np.ones(n, bool), np.zeros(m, bool)))),
            both(spans["doc"], asked["doc"], np.int64),
            pa.array(np.concatenate((spans["version"], asked["version"])).astype(np.uint32).view(np.int32)),
            both(spans["start"], asked["start"], np.int64),
            both(spans["stop"], asked["start"].astype(np.int64) + asked["more"], np.int64),
            both(zero, asked["anchor"], np.int32),
            both(zero, grams, np.int64),
        ],
        ["is_span", "doc_id", "version", "start", "stop", "anchor", "gram"],
    )


def scan_suffixes(docs: DataFrame, length: int, gram: int, chunk: int, batch_size: int) -> DataFrame:
    """Spans whose context stands earlier, and the contexts that must be compared string by string."""
    partitions = partitions_for(docs)
    shards = partitions * SHARDS_EACH

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(2 * chunk + 2 * length)
        for batch in batches:
            texts = [x.as_py().encode() for x in batch.column("text")]
            keys, rows = [], []
            for k, r in suffixes(texts, *document_keys(batch), hashes, length, gram, chunk):
                keys.append(k)
                rows.append(r)
            if not rows:
                continue
            key, row = np.concatenate(keys), np.concatenate(rows)
            order = order_of(row, "context", "gram", "doc", "version", "start")
            key, row = key[order], row[order]
            head = np.maximum.accumulate(np.where(run_starts(row, "context", "gram"), np.arange(len(row)), 0))
            again = (row["doc"] != row["doc"][head]) | (row["version"] != row["version"][head]) | (row["start"] != row["start"][head])
            spans = united(spans_of(row[again], length))
            mixed = (((spread(spans["doc"].view(np.uint64)) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
            for kind, packed in ((True, pack(mixed, spans)), (False, pack((((key[~again] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64), row[~again]))):
                yield pa.RecordBatch.from_arrays([packed.column(0), pa.array(np.full(packed.num_rows, kind)), packed.column(1)], ["shard", "is_span", "block"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        known: list[np.ndarray] = []
        for batch in batches:
            for shard, is_span, block in zip(batch.column("shard").to_pylist(), batch.column("is_span").to_pylist(), batch.column("block")):
                if is_span:
                    known.append(np.frombuffer(block.as_buffer(), SPAN))
                else:
                    held.setdefault(shard, []).append(np.frombuffer(block.as_buffer(), SUFFIX))
        nothing = np.empty(0, SUFFIX)
        if known:
            yield found_batch(united(np.concatenate(known)), nothing, nothing["doc"])
        while held:
            shard, blocks = held.popitem()
            rows = np.concatenate(blocks)
            again = repeats(rows, "gram", "context", size=batch_size)
            firsts = rows[~again]
            firsts = firsts[order_of(firsts, "gram", "context")]
            gram_starts = np.flatnonzero(run_starts(firsts, "gram"))
            sizes = np.diff(np.concatenate((gram_starts, [len(firsts)])))
            kinds = np.add.reduceat(run_starts(firsts, "gram", "context").astype(np.int64), gram_starts) if len(firsts) else sizes
            asked = firsts[np.repeat(kinds > 1, sizes)]
            yield found_batch(united(spans_of(rows[again], length)), asked, asked["gram"].astype(np.int64) + (np.int64(shard) << np.int64(32)))

    blocks = _versioned(docs).mapInArrow(emit, "shard int, is_span boolean, block binary")
    return deal(blocks, partitions).mapInArrow(scan, FOUND)


def compare_contexts(docs: DataFrame, asked: DataFrame, partitions: int, length: int, gram: int, batch_size: int) -> DataFrame:
    """Spans of the strings that stand earlier, among contexts with a gram in common.

    ``docs``: as ``_versioned`` gives them; ``asked``: rows of ``scan_suffixes``.
    """
    width = 2 * length - gram
    shards = partitions * SHARDS_EACH
    context = np.dtype([("gram", "<i8"), ("doc", "<i8"), ("version", "<u4"), ("start", "<u4"), ("anchor", "u1"), ("more", "u1"), ("bytes", "u1", (width,))])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            keys, versions = document_keys(batch)
            for i, (text, asks) in enumerate(zip(batch.column("text"), batch.column("asked"))):
                raw = text.as_py().encode()
                for ask in asks.as_py():
                    data = raw[ask["start"] : ask["stop"] + length]
                    rows.append((ask["gram"], keys[i], versions[i], ask["start"], ask["anchor"], ask["stop"] - ask["start"], np.frombuffer(data.ljust(width, b"\0"), np.uint8)))
            packed = np.array(rows, context) if rows else np.empty(0, context)
            yield pack((spread(packed["gram"].view(np.uint64)) % np.uint64(shards)).astype(np.int64), packed)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = Hashes(width), {}
        for batch in batches:
            for shard, block in zip(batch.column("shard").to_pylist(), batch.column("block")):
                held.setdefault(shard, []).append(np.frombuffer(block.as_buffer(), context))
        while held:
            rows = np.concatenate(held.popitem()[1])
            strings = []
            for at in range(0, len(rows), CONTEXTS):
                some = rows[at : at + CONTEXTS]
                data = some["bytes"].astype(np.uint64) + np.uint64(1)
                sums = np.zeros((len(some), width + 1), np.uint64)
                np.cumsum(data * hashes.up[:width], axis=1, out=sums[:, 1:])
                i, p = np.nonzero(np.arange(width - length + 1)[None, :] <= some["more"][:, None])
                value = spread((sums[i, p + length] - sums[i, p]) * hashes.down[p])
                out = np.empty(len(i), [("string", "<u8"), ("gram", "<i8"), ("doc", "<i8"), ("version", "<u4"), ("start", "<u4")])
                out["string"], out["gram"] = value, some["gram"][i] * np.int64(256) + (some["anchor"][i].astype(np.int64) - p)
                out["doc"], out["version"], out["start"] = some["doc"][i], some["version"][i], some["start"][i] + p.astype(np.uint32)
                strings.append(out)
            every = np.concatenate(strings)
            hit = every[repeats(every, "string", "gram", size=16 * batch_size)]
            spans = np.empty(len(hit), SPAN)
            for name in ("doc", "version", "start"):
                spans[name] = hit[name]
            spans["stop"] = hit["start"] + np.uint32(length)
            nothing = np.empty(0, SUFFIX)
            yield found_batch(united(spans), nothing, nothing["doc"])

    by_doc = asked.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "stop", "anchor", "gram")).alias("asked"))
    wanted = docs.join(by_doc, ["doc_id", "version"]).select("doc_id", "version", "text", "asked")
    return deal(wanted.mapInArrow(fetch, "shard int, block binary"), partitions).mapInArrow(meet, FOUND)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, batch_size: int = BATCH) -> DataFrame:
    """doc_id, n_bytes, spans (removed, maximal: start and stop in bytes) and kept (the other bytes) of each row."""
    if not 8 <= gram <= length <= 250:
        raise ValueError("8 <= gram <= length <= 250")
    found = materialize(scan_suffixes(docs, length, gram, chunk, batch_size), "suffixes")
    versioned = _versioned(docs)
    late = compare_contexts(versioned, found.where("not is_span"), partitions_for(docs), length, gram, batch_size)
    spans = found.where("is_span").select("doc_id", "version", "start", "stop").union(late.select("doc_id", "version", "start", "stop"))
    by_doc = spans.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, runs, kept = batch.column("doc_id").to_pylist(), [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                raw, merged = text.as_py().encode(), []
                for s in sorted((x["start"], x["stop"]) for x in spans.as_py() or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                edges = [0, *(x for s in merged for x in s), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                sizes.append(len(raw))
                runs.append([{"start": a, "stop": b} for a, b in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            plain = [None if x == int(NO_ID) else x for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(plain, pa.int64()), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = versioned.join(by_doc, ["doc_id", "version"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
