"""The whole retrieval evaluation as one set of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from corpusloom import rules
from corpusloom.operators import evaluation as E
from corpusloom.operators.ranking import alpha_sweep, pool
from corpusloom.operators.relevance import auto_relevant, label_coverage
from corpusloom.operators.search import bm25_search, vector_search
from corpusloom.session import materialize


def retrieval_sweep(
    items: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    alphas: Sequence[float] = rules.ALPHA_GRID,
    k_grid: Sequence[int] = rules.K_GRID,
    max_k: int = rules.MAX_K,
    splits: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Ranks for every weight, automatic labels, metric grid, chosen weight and depth.

    Each branch searches once.  The ranked lists (bounded by queries x k) and the labels are written to
    the shared folder because several results read them.
    """
    dense, sparse = vector_search(queries, corpus, max_k), bm25_search(queries, corpus, max_k)
    ranked = materialize(alpha_sweep(dense, sparse, alphas, max_k), "ranks")
    labels = materialize(auto_relevant(items, corpus), "labels")
    weights = corpus.sparkSession.createDataFrame([(float(a),) for a in alphas], "alpha double")
    grid = materialize(E.metric_grid(ranked, labels, k_grid, ("alpha",), weights, splits), "grid")
    overall = grid.filter("split_by = 'overall'") if splits is not None else grid
    return {
        "ranked": ranked,
        "labels": labels,
        "coverage": label_coverage(items, labels),
        "pool": pool(ranked, corpus),
        "grid": grid,
        "alpha": E.pick_alpha(overall),
        "saturation": E.saturation_k(overall, max_k=max_k),
    }
