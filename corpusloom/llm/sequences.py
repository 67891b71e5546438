"""Token ids as Arrow files of equal-length sequences.

Documents are dealt out by ranges of their id, tokenized where they lie, and written in order: one Arrow
file for each partition, ``part-00000.arrow`` and on.  A row of a file is one sequence:

* ``ids``: fixed-size list, the ids of documents one after another, each with its end id;
* ``mask``: fixed-size list of booleans, false where the last row of a file is padded;
* ``ends``: fixed-size list of booleans, true at the last id of each document;
* ``docs``: ids of the documents that end in this row, in order.

Fixed-size lists have no offsets: row i of a mapped file lies at a known place, and ``sequence`` gives it
without a copy.  Ids take 16 bits if the vocabulary fits, else 32.  A file is written under a name of its
own attempt and then renamed, so that a repeated task replaces it by the same bytes.

Words are encoded by the tokenizer library, and kept in a bounded cache: its normalizer and pattern never
join what stands on both sides of ASCII white space.

Defined cases: a null or empty text is the end id alone; null document ids come first; rows with equal ids
are ordered by text; other columns are not written.  An empty table writes no file.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import partitions_for

SEQUENCE = 2048
#: Rows of one record batch.
ROWS = 256
#: Words encoded at once, and entries of the cache.
CACHE_ENTRIES = 400_000
WORDS_AT_ONCE = 2048
DOCS_AT_ONCE = 256
MANIFEST = "file int, path string, n_docs long, n_tokens long"


class WordIds:
    """Ids of texts through the tokenizer library, word by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.width = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.cache: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        # lower-casing A-Z first saves entries, but would make special tokens of other strings
        split = [(raw if b"<|" in raw else raw.lower()).split() for raw in (t.encode() for t in texts)]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        new = set().union(*split) - self.cache.keys()
        # a comma or full stop after an ASCII letter is a piece of its own: such words are put together
        ended = {w for w in new if w[-1:] in (b",", b".") and w[-2:-1].isalpha()}
        self.add(((new - ended) | {w[:-1] for w in ended} | {w[-1:] for w in ended}) - self.cache.keys())
        self.cache.update((w, self.cache[w[:-1]] + self.cache[w[-1:]]) for w in ended)
        return [b"".join(map(self.cache.__getitem__, words)) for words in split]


    def add(self, words: set[bytes]) -> None:
        """Encode new words, many as one text; its tokens' offsets tell whose they are."""
        odd = [w for w in words if b"<|" in w]
        for word, found in zip(odd, self.library.encode_batch([w.decode() for w in odd], add_special_tokens=False)):
            self.cache[word] = np.array(found.ids, self.width).tobytes()
        listed = [w for w in words if b"<|" not in w]
        for start in range(0, len(listed), WORDS_AT_ONCE):
            some = listed[start : start + WORDS_AT_ONCE]
            texts = [w.decode() for w in some]
            found = self.library.encode(" ".join(texts), add_special_tokens=False)
            begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
            owner = np.searchsorted(begins, np.fromiter((o[0] for o in found.offsets), np.int64), "right") - 1
            cuts = np.searchsorted(owner, np.arange(len(some) + 1)) * self.width.itemsize
            packed = np.array(found.ids, self.width).tobytes()
            self.cache.update((w, packed[a:b]) for w, a, b in zip(some, cuts.tolist(), cuts[1:].tolist()))


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def file_schema(width: np.dtype, length: int) -> pa.Schema:
    return pa.schema(
        [
            ("ids", pa.list_(pa.from_numpy_dtype(width), length)),
            ("mask", pa.list_(pa.bool_(), length)),
            ("ends", pa.list_(pa.bool_(), length)),
            ("docs", pa.list_(pa.int64())),
        ]
    )


def open_folder(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)


class SequenceWriter:
    """Fills rows of ``length`` ids and writes them batch by batch."""

    def __init__(self, sink, width: np.dtype, length: int):
        self.width, self.length, self.schema = width, length, file_schema(width, length)
        self.out = pa.ipc.new_file(sink, self.schema)
        self.ids, self.docs, self.ends, self.held = [], [], [], 0

    def add(self, doc_id: int | None, packed: bytes) -> None:
        self.ids.append(packed)
        self.held += len(packed) // self.width.itemsize
        self.docs.append(doc_id)
        self.ends.append(self.held - 1)
        if self.held >= ROWS * self.length:
            self.flush(self.held // (ROWS * self.length) * ROWS)

    def flush(self, rows: int) -> None:
        ids, take = np.frombuffer(b"".join(self.ids), self.width), rows * self.length
        real = min(take, len(ids))
        full, mask, ends = np.zeros(take, self.width), np.zeros(take, bool), np.zeros(take, bool)
        full[:real], mask[:real] = ids[:real], True
        stops = np.array(self.ends, np.int64)
        n = int(np.searchsorted(stops, take))
        ends[stops[:n]] = True
        cuts = np.searchsorted(stops[:n], np.arange(0, take + 1, self.length)).astype(np.int32)
        fixed = lambda values, kind: pa.FixedSizeListArray.from_arrays(pa.array(values, kind), type=kind_list(kind, self.length))
        docs = pa.ListArray.from_arrays(pa.array(cuts), pa.array(self.docs[:n], pa.int64()))
        columns = [fixed(full, pa.from_numpy_dtype(self.width)), fixed(mask, pa.bool_()), fixed(ends, pa.bool_()), docs]
        batch = pa.RecordBatch.from_arrays(columns, schema=self.schema)
        for row in range(0, rows, ROWS):
            self.out.write_batch(batch.slice(row, ROWS))
        self.ids, self.docs, self.ends, self.held = [ids[real:].tobytes()], self.docs[n:], (stops[n:] - take).tolist(), len(ids) - real

    def close(self) -> None:
        if self.held:
            self.flush(-(-self.held // self.length))
        self.out.close()


def kind_list(kind: pa.DataType, length: int) -> pa.DataType:
    return pa.list_(kind, length)


def write_sequences(docs: DataFrame, folder: str, path: str, end_id: int, length: int = SEQUENCE) -> DataFrame:
    """Write all documents below ``folder``; the list of files: file, path, n_docs, n_tokens.

    The list must be written or collected once; that is what writes the files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder, writer, sink, n_docs, n_tokens = TaskContext.get().partitionId(), word_ids(path), None, None, 0, 0
        fs, root = open_folder(folder)
        name, own = f"{root}/part-{part:05d}.arrow", f"{root}/_{part:05d}-{uuid.uuid4().hex}"
        end = np.array([end_id], coder.width).tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                some = batch.slice(start, DOCS_AT_ONCE)
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(own)
                    writer = SequenceWriter(sink, coder.width, length)
                for doc_id, packed in zip(some.column("doc_id").to_pylist(), coder.encode([x or "" for x in some.column("text").to_pylist()])):
                    writer.add(doc_id, packed + end)
                    n_docs += 1
                    n_tokens += len(packed) // coder.width.itemsize + 1
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(own, name)
            yield pa.RecordBatch.from_pydict({"file": pa.array([part], pa.int32()), "path": [name], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_tie"))
    dealt = ordered.repartitionByRange(partitions_for(docs), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text")
    return dealt.select("doc_id", "text").mapInArrow(run, MANIFEST)


def sequence(path: str, row: int) -> dict[str, pa.Array]:
    """One sequence of a file and its mask, mapped, without a copy."""
    with pa.memory_map(path) as source:
        reader = pa.ipc.open_file(source)
        batch = reader.get_batch(row // ROWS)
        at = row % ROWS
        length = batch.schema.field("ids").type.list_size
        return {name: batch.column(name).values.slice(at * length, length) for name in ("ids", "mask")}


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Documents as the files hold them: doc_id, start (ids before it in all files), n_tokens, ids.

    ``ids`` are packed little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                file, start, rest = int(path.as_py().rpartition("part-")[2][:-6]), 0, b""
                reader = pa.ipc.open_file(pa.BufferReader(content.as_buffer()))
                for k in range(reader.num_record_batches):
                    rows = reader.get_batch(k)
                    ids = rows.column("ids").values.to_numpy(zero_copy_only=False)
                    ends = np.flatnonzero(rows.column("ends").values.to_numpy(zero_copy_only=False)) + 1
                    real = int(np.count_nonzero(rows.column("mask").values.to_numpy(zero_copy_only=False)))
                    raw = rest + ids[:real].astype("<u4").tobytes()
                    cuts = np.concatenate(([0], ends * 4 + len(rest))).astype(np.int64)
                    rest = raw[cuts[-1] :]
                    sizes = np.diff(cuts) // 4
                    packed = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)])
                    starts = start + np.concatenate(([0], np.cumsum(sizes)))
                    start = int(starts[-1])
                    columns = [pa.array(np.full(len(ends), file, np.int32)), rows.column("docs").values, pa.array(starts[:-1]), pa.array(sizes), packed]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "offset", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.arrow").load(folder).select("path", "content")
    found = files.mapInArrow(run, "file int, doc_id long, offset long, n_tokens long, ids binary")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return found.join(bases, "file").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids")
