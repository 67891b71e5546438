"""Top-k, rank fusion and small ranking helpers shared by search and evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import rules
from corpusloom.functions.text import rounded


def top_k(
    scored: DataFrame,
    k: int = rules.CANDIDATES,
    by: Sequence[str] = ("query_id",),
    score: str = "score",
    ties: Sequence[str] = ("chunk_id",),
) -> DataFrame:
    """Best ``k`` rows per group with a 1-based ``rank``; equal scores are ordered by ``ties``.

    The lone ``row_number`` filter lets Spark keep only k rows per group and task before the shuffle,
    so a group that holds most of the rows is cut down where it is read.
    """
    order = [F.col(score).desc_nulls_last(), *[F.col(c).asc() for c in ties]]
    window = Window.partitionBy(*by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def fused_contributions(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Both ranked lists side by side: (query_id, chunk_id, dense_part, sparse_part), 0 where absent."""
    keys = ["query_id", "chunk_id"]
    part = F.lit(1.0) / (F.lit(rules.RRF_CONSTANT) + F.col("rank"))
    joined = dense.select(*keys, part.alias("d")).join(sparse.select(*keys, part.alias("s")), keys, "full")
    return joined.select(
        *keys, F.coalesce("d", F.lit(0.0)).alias("dense_part"), F.coalesce("s", F.lit(0.0)).alias("sparse_part")
    )


def _fused_score(alpha: Column) -> Column:
    return rounded(alpha * F.col("dense_part") + (1 - alpha) * F.col("sparse_part"), 9).alias("score")


def weighted_rrf(
    dense: DataFrame, sparse: DataFrame, alpha: float | None = None, k: int = rules.CANDIDATES
) -> DataFrame:
    """alpha/(60+rank) from the dense list plus (1-alpha)/(60+rank) from the sparse one.

    ``None`` means the default weight.  Rows of a branch with weight zero do not count, so 0 is pure
    keyword order and 1 pure vector order.
    """
    a = F.lit(rules.HYBRID_ALPHA if alpha is None else float(alpha))
    fused = fused_contributions(dense, sparse).select("query_id", "chunk_id", _fused_score(a))
    return top_k(fused.filter(F.col("score") > 0), k)


def alpha_sweep(
    dense: DataFrame,
    sparse: DataFrame,
    alphas: Sequence[float] = rules.ALPHA_GRID,
    max_k: int = rules.MAX_K,
) -> DataFrame:
    """Fusion for every weight at once: the branches are ranked once, only their ranks are re-weighted."""
    grid = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    parts = fused_contributions(dense, sparse).select("*", grid)
    fused = parts.select("alpha", "query_id", "chunk_id", _fused_score(F.col("alpha")))
    return top_k(fused.filter(F.col("score") > 0), max_k, by=("alpha", "query_id"))


def pool(ranked: DataFrame, corpus: DataFrame, depth: int = rules.POOL_DEPTH) -> DataFrame:
    """Distinct (query, chunk) pairs within ``depth`` in any list, restricted to chunks of the corpus."""
    pairs = ranked.filter(F.col("rank") <= depth).select("query_id", "chunk_id").distinct()
    return pairs.join(corpus.select("chunk_id"), "chunk_id", "left_semi").select("query_id", "chunk_id")


def rerank(candidates: DataFrame, scores: DataFrame, top_n: int = rules.RERANK_TOP_N) -> DataFrame:
    """Reorder candidates by an external pair score and keep the best ``top_n``."""
    pairs = candidates.drop("rank", "score").join(
        scores.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"], "left"
    )
    return top_k(pairs, top_n)


def merge_subqueries(lists: DataFrame, cap: int = rules.MERGED_CAP) -> DataFrame:
    """Merge ranked lists of one question: first occurrence of each chunk, best score first, capped.

    ``lists(query_id, list_no, pos, chunk_id, score)``; a missing score counts as 0, equal scores keep
    the order of first occurrence.
    """
    first = lists.groupBy("query_id", "chunk_id").agg(
        F.min(F.struct("list_no", "pos", "score")).alias("f")
    )
    rows = first.select(
        "query_id",
        "chunk_id",
        F.col("f.list_no").alias("list_no"),
        F.col("f.pos").alias("pos"),
        F.col("f.score").alias("score"),
        F.coalesce("f.score", F.lit(0.0)).alias("_sort"),
    )
    return top_k(rows, cap, score="_sort", ties=("list_no", "pos")).drop("_sort")
