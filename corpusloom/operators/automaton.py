"""Many names or keywords looked for in one pass over each text.

The names travel to the tasks in blocks of a stated number of bytes; each task builds one Aho-Corasick automaton of
its block and reads every text once, however many names there are.  More names than one block holds take one
pass for each block, by the same plan.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpusloom.functions.text import normalized

# Task code travels with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of names in a block; the automaton of a task takes about thirty times as many.
NAME_BYTES = 8 << 20
#: Rows of a batch that a task hands on.
OUT_ROWS = 8192
#: Texts that a task turns into Python strings at once.
TEXT_ROWS = 256
_GLUE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def blocks_of(rows: DataFrame, size: Callable[[ST.Row], int], most: int) -> Iterator[list[ST.Row]]:
    """Rows in blocks of at most ``most`` by ``size`` (one row at least); partitions reach the driver one by one."""
    block, held = [], 0
    for row in rows.toLocalIterator():
        n = size(row)
        if block and held + n > most:
            yield block
            block, held = [], 0
        block.append(row)
        held += n
    if block:
        yield block


def automaton(words: Sequence[str]) -> ahocorasick.Automaton:
    """Finds the number of each of ``words``."""
    found = ahocorasick.Automaton()
    for i, word in enumerate(words):
        found.add_word(word, i)
    found.make_automaton()
    return found


def whole_words(search: ahocorasick.Automaton, words: Sequence[str], body: str) -> set[int]:
    """Numbers of the words in ``body`` that are not glued to another ASCII letter or digit."""
    out, last = set(), len(body) - 1
    for end, i in search.iter(body):
        start = end - len(words[i])
        if i not in out and (start < 0 or body[start] not in _GLUE) and (end == last or body[end + 1] not in _GLUE):
            out.add(i)
    return out


def longest_name(names: list[tuple[int, str, str]]) -> Callable[[Column], Column]:
    """Of the listed (length, name, lower-cased name) the longest in a lower-cased text, then the smallest: struct n, name."""
    best: dict[str, tuple[int, str]] = {}
    for n, name, low in names:
        if low not in best or (-n, name) < best[low]:
            best[low] = (-n, name)
    words, values = list(best), list(best.values())

    built: list = []

    def run(texts: pd.Series) -> pd.DataFrame:
        if not built:  # once for each task
            built.append(automaton(words))
        top = [min((values[i] for _, i in built[0].iter(t)), default=(None, None)) if t else (None, None) for t in texts]
        return pd.DataFrame({"n": pd.array([n for n, _ in top], "Int64"), "name": pd.Series([x for _, x in top], dtype=object)})

    return F.pandas_udf(run, "n long, name string")


def _emitted(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    waiting = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)

    for row in rows:
        waiting.append(row)
        if len(waiting) == OUT_ROWS:
            yield batch()
            waiting = []
    if waiting:
        yield batch()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str]]:
    """chunk_id and normalized text of each row."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXT_ROWS):
            part = batch.slice(at, TEXT_ROWS)
            yield from zip(part.column(0).to_pylist(), map(normalized, part.column(1).to_pylist()))


def words_by_text(texts: DataFrame, words: list[str]) -> DataFrame:
    """(keyword, chunk_id) for each of ``words`` that the normalized ``texts(chunk_id, text)`` hold as a whole word."""
    out = ST.StructType([ST.StructField("keyword", ST.StringType()), texts.schema["chunk_id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, schema = automaton(words), None
        for batch in batches:
            schema = schema or pa.schema([pa.field("keyword", pa.string()), pa.field("chunk_id", batch.schema.field(0).type)])
            yield from _emitted(((words[i], key) for key, body in _texts(iter([batch])) for i in sorted(whole_words(search, words, body))), schema)

    return texts.mapInArrow(run, out)


def word_counts(texts: DataFrame, words: list[str], keep: int) -> DataFrame:
    """(keyword, n, ids) for each task and word: rows that hold it, and their ids where they are at most ``keep``."""
    out = ST.StructType(
        [ST.StructField("keyword", ST.StringType()), ST.StructField("n", ST.LongType()), ST.StructField("ids", ST.ArrayType(texts.schema["chunk_id"].dataType))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, counts, ids, kind = automaton(words), {}, {}, pa.null()
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, body in _texts(iter([batch])):
                for i in whole_words(search, words, body):
                    counts[i] = counts.get(i, 0) + 1
                    if counts[i] <= keep:
                        ids.setdefault(i, []).append(key)
                    else:
                        ids.pop(i, None)
        schema = pa.schema([pa.field("keyword", pa.string()), pa.field("n", pa.int64()), pa.field("ids", pa.list_(kind))])
        yield from _emitted(((words[i], n, ids.get(i, [])) for i, n in counts.items()), schema)

    return texts.mapInArrow(run, out)


def items_by_text(texts: DataFrame, items: list[tuple[object, list[tuple[str, bool]]]], id_type: ST.DataType) -> DataFrame:
    """(query_id, chunk_id) where a text holds all keywords of an item and at least one that is marked."""
    words = sorted({w for _, keywords in items for w, _ in keywords})
    number = {w: i for i, w in enumerate(words)}
    needed = [frozenset(number[w] for w, _ in keywords) for _, keywords in items]
    by_marked: dict[int, list[int]] = {}
    for q, (_, keywords) in enumerate(items):
        for w in {w for w, marked in keywords if marked}:
            by_marked.setdefault(number[w], []).append(q)
    ids = [key for key, _ in items]
    out = ST.StructType([ST.StructField("query_id", id_type), texts.schema["chunk_id"]])

    def held(search: ahocorasick.Automaton, batch: pa.RecordBatch) -> Iterator[tuple]:
        for key, body in _texts(iter([batch])):
            found = whole_words(search, words, body)
            for q in sorted({q for i in found for q in by_marked.get(i, ())}):
                if needed[q] <= found:
                    yield ids[q], key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, id_kind = automaton(words), pa.array(ids).type
        for batch in batches:
            yield from _emitted(held(search, batch), pa.schema([pa.field("query_id", id_kind), pa.field("chunk_id", batch.schema.field(0).type)]))

    return texts.mapInArrow(run, out)
