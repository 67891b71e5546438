"""What searches share: the best rows per query in a task, and blocks of queries."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Task code travels with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERY_BLOCK = 4096
HELD_ROWS, HELD_PARTS = 50_000, 5_000  # rows, and arrays of rows, that wait in a task before they are cut to the best


def pieces(batches: Iterator[pa.RecordBatch], sizes: Callable[[pa.RecordBatch], np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose sizes add up to at most ``most`` (one row at least)."""
    for batch in batches:
        ends, start = np.concatenate(([0], np.cumsum(sizes(batch), dtype=np.int64))), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


class _Best:
    """The k best rows per query seen by one task."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.floor = np.full(n_queries, -np.inf)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = self.kept = 0

    def add(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        row, query = np.nonzero(allowed & (scores >= self.floor))
        self.take(query, ids[row], scores[row, query])

    def take(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(query):
            self.rows.append((query, ids, scores))
            self.held += len(query)
        if self.held > max(HELD_ROWS, self.kept) or len(self.rows) > HELD_PARTS:
            self.compact()

    def result(self, query_ids: np.ndarray, kind: pa.DataType | None) -> Iterator[pa.RecordBatch]:
        rows = self.compact()
        if rows is not None and len(rows):
            columns = [pa.array(query_ids[rows["q"].to_numpy()]), pa.array(rows["i"].to_numpy(), type=kind), pa.array(rows["s"].to_numpy())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "score"])

    def compact(self) -> pd.DataFrame | None:
        if not self.rows:
            return None
        best = pd.DataFrame(dict(zip("qis", map(np.concatenate, zip(*self.rows)))))
        best = best.sort_values(["q", "s", "i"], ascending=[True, False, True], kind="stable")
        best = best[best.groupby("q").cumcount() < self.k]
        full = best.groupby("q")["s"].agg(["size", "min"])
        full = full[full["size"] >= self.k]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()
        self.rows, self.held, self.kept = [(best["q"].to_numpy(), best["i"].to_numpy(), best["s"].to_numpy())], 0, len(best)
        return best


def query_blocks(queries: DataFrame, columns: Sequence[str], size: int = QUERY_BLOCK) -> Iterator[pd.DataFrame]:
    """The queries as bounded local blocks.  The size is checked before anything is fetched."""
    wanted = queries.select(*columns)
    head = wanted.limit(size + 1).toPandas()
    if len(head) <= size:
        if len(head):
            yield head
        return
    n = 2 * (queries.count() // size + 1)
    for i in range(n):
        part = wanted.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toPandas()
        if len(part):
            yield part
