"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that every operator here splits at: blank and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
#: A word, as a pattern for Java and for RE2.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of text that one partition of a re-dealt corpus should hold.
PARTITION_BYTES = 48 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else.  Pure ASCII strings take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions_for(df: DataFrame, column: str = "text", bytes_each: int = PARTITION_BYTES) -> int:
    """Partitions for a re-dealt ``df``: they grow with the bytes that the optimizer expects.

    Where it knows nothing (a table that comes from no file), the bytes of ``column`` are added up.
    """
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if expected >= 1 << 60:
        expected = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-expected // bytes_each))


def text_values(column: pa.Array) -> list[str]:
    """Strings of an Arrow column; nulls become the empty string."""
    return [x or "" for x in column.to_pylist()]


def pack(shard: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Rows of a structured array as one binary block for each shard number."""
    order = np.argsort(shard, kind="stable")
    shard, rows = shard[order], rows[order]
    cuts = np.flatnonzero(np.diff(shard)) + 1
    starts = np.concatenate(([0], cuts)) if len(shard) else np.empty(0, np.int64)
    offsets = np.concatenate((starts, [len(shard)])).astype(np.int64) * rows.dtype.itemsize
    if len(offsets) and offsets[-1] >= 1 << 31:
        raise ValueError("a block of one task is over 2 GB: use smaller input splits")
    blocks = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows).view(np.uint8).data)]
    )
    return pa.RecordBatch.from_arrays([pa.array(shard[starts].astype(np.int32)), blocks], ["shard", "block"])


PACKED = "shard int, block binary"


def deal(blocks: DataFrame, partitions: int) -> DataFrame:
    """Packed blocks, all of a shard in one task."""
    return blocks.repartition(partitions, "shard")


def unpack(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> np.ndarray:
    """All rows that a task holds, as one structured array."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for batch in batches for x in batch.column("block") if x.is_valid]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def spread(key: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit values of 64-bit keys."""
    x = key.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the public tokenizers, or of the folder in TOKENIZER_DIR."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
