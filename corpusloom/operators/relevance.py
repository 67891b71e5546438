"""Automatic relevance labels, found in the chunk's own task; never item x chunk.

References and keywords travel to the tasks in blocks of a stated number of bytes, one pass over the corpus for each
block.  A task counts shared trigrams and looks keywords up by one automaton where the text lies, so what a frequent
trigram or keyword matches never leaves the task: only pairs that pass are handed on.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpusloom import rules
from corpusloom.functions import text as T
from corpusloom.functions.text import normalized
from corpusloom.operators.automaton import NAME_BYTES, blocks_of, items_by_text, word_counts, words_by_text
from corpusloom.operators.task_search import pieces
from corpusloom.session import broadcast_if_small, materialize

# Task code travels with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REFERENCE_BYTES = 16 << 20  # bytes of reference text that one pass over the corpus looks for
NEAR_CHUNKS = 100_000  # ids of candidate chunks that are broadcast; more are joined by shuffle
_CELLS = 1 << 19  # numbers held at once by a task
TEXT_BYTES = 4 << 20  # texts that a task compares at once; more where the references are larger


class ReferenceIndex:
    """The distinct word trigrams of a block of references, for counting by numbers of words and trigrams.

    A reference with n trigrams of which m must be shared is a candidate only where a chunk holds one of any n - m + 1
    of them.  These are chosen rarest first, by how many chunks of the batch at hand hold each: any choice gives the
    same result, and a trigram that every chunk holds makes no candidates where rarer ones suffice.
    """

    def __init__(self, references: list[list[str]], threshold: float | None) -> None:
        self.vocabulary: dict[str, int] = {}
        grams: dict[tuple[int, ...], int] = {}
        lists = []
        for words in references:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            lists.append(sorted({grams.setdefault(g, len(grams)) for g in _trigrams(codes)}))
        self.base = len(self.vocabulary) + 2
        packed = np.array([self.pack(*g) for g in grams], np.int64)
        order = np.argsort(packed)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.keys = packed[order]
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.grams = place[np.array([g for x in lists for g in x], np.int64)] if grams else np.empty(0, np.int64)
        self.owners = np.repeat(np.arange(len(lists)), self.sizes)
        self.least = np.array([_least_shared(len(x), threshold) for x in lists], np.int64)

    def pack(self, a, b, c):
        """One number of three words; words are numbered from 0, absent ones -1 (no word) and -2 (unknown)."""
        return ((a + 2) * self.base + (b + 2)) * self.base + (c + 2)

    def held(self, bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, trigram) of the block's trigrams that normalized texts hold."""
        codes, rows = [], []
        get = self.vocabulary.get
        for i, body in enumerate(bodies):
            words = body.split(" ") if body else []
            found = [get(w, -2) for w in words] + ([-1] * (3 - len(words)) if 0 < len(words) < 3 else [])
            codes += found
            codes.append(-2)
            rows.append(len(found) + 1)
        c, row = np.array(codes, np.int64), np.repeat(np.arange(len(bodies)), rows)
        a, b, c = c[:-2], c[1:-1], c[2:]
        known = (a >= 0) & (b != -2) & (c != -2)
        keys, row = self.pack(a[known], b[known], c[known]), row[: len(a)][known]
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        both = np.unique(row[hit] * len(self.keys) + at[hit])
        return both // max(len(self.keys), 1), both % max(len(self.keys), 1)

    def matches(self, bodies: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, references and numbers of shared trigrams of all pairs that share enough."""
        row, gram = self.held(bodies)
        if not len(row):
            return
        frequency = np.bincount(gram, minlength=len(self.keys))
        order = np.lexsort((self.grams, frequency[self.grams], self.owners))
        rank = np.arange(len(order)) - self.starts[self.owners]
        prefix = order[rank < (self.sizes - self.least + 1)[self.owners]]
        prefix = prefix[np.argsort(self.grams[prefix], kind="stable")]
        n_owners = np.bincount(self.grams[prefix], minlength=len(self.keys))
        first = np.concatenate(([0], np.cumsum(n_owners)))
        both = np.sort(row * len(self.keys) + gram)
        for part in _parts(n_owners[gram]):
            owners = _spread(self.owners[prefix], first[gram[part]], n_owners[gram[part]])
            pairs = np.unique(np.repeat(row[part], n_owners[gram[part]]) * len(self.sizes) + owners)
            yield from self._counted(pairs, both)

    def _counted(self, pairs: np.ndarray, both: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        row, ref = pairs // len(self.sizes), pairs % len(self.sizes)
        for part in _parts(self.sizes[ref]):
            wanted = _spread(self.grams, self.starts[ref[part]], self.sizes[ref[part]])
            keys = np.repeat(row[part], self.sizes[ref[part]]) * len(self.keys) + wanted
            at = np.minimum(np.searchsorted(both, keys), len(both) - 1)
            ends = np.cumsum(self.sizes[ref[part]])
            total = np.concatenate(([0], np.cumsum(both[at] == keys)))
            shared = total[ends] - total[ends - self.sizes[ref[part]]]
            good = shared >= self.least[ref[part]]
            yield row[part][good], ref[part][good], shared[good]


def _trigrams(codes: list[int]) -> list[tuple[int, ...]]:
    """Word trigrams; a shorter text gives one of all its words."""
    if not codes:
        return []
    padded = codes + [-1] * (3 - len(codes))
    return list(zip(padded, padded[1:], padded[2:]))


def _least_shared(n: int, threshold: float | None) -> int:
    """The least number of n trigrams whose share, rounded to six digits, reaches the threshold."""
    if threshold is None or n == 0:
        return 1
    s = max(int(threshold * n) - 1, 1)
    while s <= n and np.floor(s / n * 1e6 + 0.5) / 1e6 < threshold:
        s += 1
    return s


def _parts(sizes: np.ndarray) -> Iterator[slice]:
    """Slices whose sizes add up to about ``_CELLS``."""
    if len(sizes):
        group = np.cumsum(sizes) // _CELLS
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        yield from (slice(a, b) for a, b in zip(cuts, cuts[1:]))


def _spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values[start : start + size]`` of all, one after the other."""
    ends = np.cumsum(sizes)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    return values[np.repeat(starts, sizes) + inside]


def shared_trigrams(items: DataFrame, corpus: DataFrame, threshold: float | None = None, block_bytes: int = REFERENCE_BYTES) -> DataFrame:
    """(query_id, chunk_id, recall) for every pair that shares a word trigram, or whose recall reaches ``threshold``.

    ``items(query_id, reference)``, ``corpus(chunk_id, text)``; both are expected to hold an id once.  Pairs are counted
    inside the task that holds the chunk, so nothing is shuffled.  References beyond ``block_bytes`` take further
    passes over the corpus.  Items without words match nothing.
    """
    texts = corpus.select("chunk_id", "text")
    wanted = items.select("query_id", T.words("reference").alias("words")).where(F.size("words") > 0)
    kinds = [items.schema["query_id"], corpus.schema["chunk_id"]]
    out = ST.StructType([*kinds, ST.StructField("shared", ST.LongType()), ST.StructField("n_grams", ST.LongType())])

    def found(block: list[ST.Row]) -> DataFrame:
        index = ReferenceIndex([r.words for r in block], threshold)
        ids = pa.array([r.query_id for r in block])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts_of = lambda batch: pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            for batch in pieces(batches, texts_of, max(TEXT_BYTES, 4 * index.keys.nbytes)):
                for rows, refs, shared in index.matches([normalized(t) for t in batch.column(1).to_pylist()]):
                    columns = [ids.take(pa.array(refs)), batch.column(0).take(pa.array(rows)), pa.array(shared), pa.array(index.sizes[refs])]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "chunk_id", "shared", "n_grams"])

        return texts.mapInArrow(run, out)

    parts = [found(block) for block in blocks_of(wanted, lambda r: sum(4 * len(w) + 4 for w in r.words), block_bytes)]
    pairs = reduce(DataFrame.unionByName, parts) if parts else items.sparkSession.createDataFrame([], out)
    return pairs.select("query_id", "chunk_id", T.rounded(F.col("shared") / F.col("n_grams")).alias("recall"))


def item_keywords(items: DataFrame) -> DataFrame:
    """Distinct (query_id, keyword) with normalized non-blank keywords."""
    return (
        items.select("query_id", F.explode_outer("keywords").alias("kw"))
        .select("query_id", T.normalize_text("kw").alias("keyword"))
        .filter(F.col("keyword") != "")
        .distinct()
    )


def _word_blocks(keywords: DataFrame, small: int) -> Iterator[list[str]]:
    for block in blocks_of(keywords.select("keyword").distinct(), lambda r: len(r.keyword.encode()), small):
        yield sorted(r.keyword for r in block)


def keyword_matches(keywords: DataFrame, corpus: DataFrame, small: int = NAME_BYTES) -> DataFrame:
    """(keyword, chunk_id) for every keyword present as a whole word.

    One pass over the corpus with one automaton for each ``small`` bytes of distinct keywords.
    """
    parts = [words_by_text(corpus.select("chunk_id", "text"), words) for words in _word_blocks(keywords, small)]
    out = ST.StructType([ST.StructField("keyword", ST.StringType()), corpus.schema["chunk_id"]])
    return reduce(DataFrame.unionByName, parts) if parts else corpus.sparkSession.createDataFrame([], out)


def _counts(keywords: DataFrame, corpus: DataFrame, keep: int, small: int = NAME_BYTES) -> DataFrame | None:
    """(keyword, n, ids) by task: what a task counted, and the chunks where they are at most ``keep``."""
    parts = [word_counts(corpus.select("chunk_id", "text"), words, keep) for words in _word_blocks(keywords, small)]
    return reduce(DataFrame.unionByName, parts) if parts else None


def keyword_df(keywords: DataFrame, corpus: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Number of chunks holding each keyword; keywords found nowhere keep a zero row.

    Tasks count what they find: one row for each task and keyword is shuffled, however frequent a keyword is.
    """
    distinct = keywords.select("keyword").distinct()
    if matches is not None:
        counts = matches.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    else:
        found = _counts(keywords, corpus, 0)
        counts = (distinct.select("keyword", F.lit(0).alias("n")) if found is None else found).groupBy("keyword").agg(F.sum("n").alias("n"))
    return distinct.join(counts, "keyword", "left").select("keyword", F.coalesce("n", F.lit(0)).cast("long").alias("df"))


def _holding_all(flagged: DataFrame, corpus: DataFrame, small: int = NAME_BYTES) -> DataFrame:
    """(query_id, chunk_id) where a chunk holds all keywords of an item and at least one marked ``rare``."""
    items = flagged.groupBy("query_id").agg(F.collect_list(F.struct("keyword", "rare")).alias("keywords"))
    items = items.where(F.exists("keywords", lambda k: k["rare"]))
    kind = flagged.schema["query_id"].dataType
    parts = []
    for block in blocks_of(items, lambda r: sum(len(k.keyword.encode()) for k in r.keywords), small):
        parts.append(items_by_text(corpus.select("chunk_id", "text"), [(r.query_id, [(k.keyword, k.rare) for k in r.keywords]) for r in block], kind))
    out = ST.StructType([flagged.schema["query_id"], corpus.schema["chunk_id"]])
    return reduce(DataFrame.unionByName, parts) if parts else corpus.sparkSession.createDataFrame([], out)


def rare_keyword_hit(
    keywords: DataFrame,
    corpus: DataFrame,
    df: DataFrame | None = None,
    rare_df: int = rules.RARE_DF,
    use_df: bool = True,
) -> DataFrame:
    """(query_id, chunk_id) where all keywords of the item are present and at least one is rare.

    With ``use_df`` a keyword is rare when its document frequency is at most ``rare_df``; without it,
    when it is specific by its form.  Rare keywords come first: the pass that counts also names the few chunks that hold a
    rare keyword, and only these are read again for the others.
    """
    if not use_df:
        return _holding_all(keywords.withColumn("rare", T.is_specific("keyword")), corpus)
    if df is not None:
        return _holding_all(keywords.join(df, "keyword", "left").withColumn("rare", F.coalesce(F.col("df") <= rare_df, F.lit(False))).drop("df"), corpus)
    found = _counts(keywords, corpus, max(rare_df, 0))
    if found is None:
        return _holding_all(keywords.withColumn("rare", F.lit(False)), corpus)
    counted = materialize(found, "keyword-counts")
    rare = counted.groupBy("keyword").agg(F.sum("n").alias("df")).where(F.col("df") <= rare_df).select("keyword", F.lit(True).alias("rare"))
    near = counted.join(rare, "keyword", "left_semi").select(F.explode("ids").alias("chunk_id")).distinct()
    flagged = keywords.join(rare, "keyword", "left").withColumn("rare", F.coalesce("rare", F.lit(False)))
    return _holding_all(flagged, corpus.join(broadcast_if_small(near, NEAR_CHUNKS), "chunk_id", "left_semi"))


def auto_relevant(
    items: DataFrame,
    corpus: DataFrame,
    threshold: float = rules.OVERLAP_THRESHOLD,
    rare_df: int = rules.RARE_DF,
) -> DataFrame:
    """Relevant (query_id, chunk_id) pairs: enough shared trigrams, or all keywords with a rare one.

    ``items(query_id, reference[, keywords][, source_doc])``; items marked as having no source get none.
    """
    active = items
    if "source_doc" in items.columns:
        active = items.filter(F.coalesce(F.col("source_doc"), F.lit("")) != rules.NO_SOURCE)
    pairs = shared_trigrams(active, corpus, threshold).select("query_id", "chunk_id")
    if "keywords" not in items.columns:
        return pairs
    return pairs.unionByName(rare_keyword_hit(item_keywords(active), corpus, rare_df=rare_df)).distinct()


def label_coverage(items: DataFrame, labels: DataFrame) -> DataFrame:
    """How many items are answerable, negative (no source) or left without a label."""
    labelled = labels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    negative = (
        F.coalesce(F.col("source_doc"), F.lit("")) == rules.NO_SOURCE
        if "source_doc" in items.columns
        else F.lit(False)
    )
    kind = F.when(F.col("n_relevant").isNotNull(), "answerable").when(negative, "negative").otherwise("unlabeled")
    return (
        items.join(labelled, "query_id", "left")
        .groupBy(kind.alias("coverage"))
        .agg(F.count(F.lit(1)).alias("n_items"))
    )


def relevant_counts(labels: DataFrame) -> DataFrame:
    """Number of relevant chunks per query."""
    return labels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
