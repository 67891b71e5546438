"""Batch question answering up to the point where a model would write the answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import rules
from corpusloom.operators import search as S
from corpusloom.operators.ranking import rerank
from corpusloom.session import materialize


def prepare_contexts(
    queries: DataFrame,
    corpus: DataFrame,
    filters: Sequence[str] = (),
    scores: DataFrame | None = None,
    alpha: float | None = None,
    candidates: int = rules.CANDIDATES,
    top_n: int = rules.RERANK_TOP_N,
) -> DataFrame:
    """One row per query: numbered context, or the fixed reply when nothing was found.

    Hybrid search with filters, second search without filters where the first found nothing, rerank by
    the given pair scores (default: trigram recall), context from the best ``top_n``.
    """

    def search(qs: DataFrame) -> DataFrame:
        return S.hybrid_search(qs, corpus, candidates, alpha, filters)

    found = S.filter_fallback(queries, search, filters) if filters else search(queries)
    pair_scores = scores if scores is not None else S.trigram_scores(found, queries, corpus)
    best = materialize(rerank(found.select("query_id", "chunk_id", "rank", "score"), pair_scores, top_n), "reranked")
    contexts = S.context_block(S.source_list(best, corpus))
    gate = S.no_context_gate(queries, best)
    return gate.join(contexts, "query_id", "left").select("query_id", "n_sources", "answer", F.coalesce("context", F.lit("")).alias("context"))
