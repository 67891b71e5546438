"""Retrieval metrics, parameter sweeps, label agreement and score tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import rules
from corpusloom.functions.text import rounded

METRICS = ("precision", "recall", "f1", "hit", "ndcg")


# --- per query -----------------------------------------------------------------------------------


def judged(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """Ranked rows with ``rel``: 1 when the pair is labelled relevant, else 0."""
    marks = labels.select("query_id", "chunk_id", F.lit(1).alias("_hit"))
    return ranked.join(marks, ["query_id", "chunk_id"], "left").withColumn("rel", F.coalesce("_hit", F.lit(0))).drop("_hit")


def _ideal_dcg(total: Column, k: Column, longest: int) -> Column:
    """DCG of min(total, k) hits on top, from a running sum over the (bounded) list length."""
    sums, running = [], 0.0
    for i in range(1, longest + 1):
        running += 1.0 / math.log2(i + 1)
        sums.append(F.lit(running))
    return F.get(F.array(*sums), F.least(total, k).cast("int") - 1)


def query_metrics(
    ranked: DataFrame,
    totals: DataFrame,
    k_grid: Sequence[int] = rules.K_GRID,
    by: Sequence[str] = (),
    grid: DataFrame | None = None,
    cut_reciprocal: bool = False,
) -> DataFrame:
    """All metrics of every query at every k, from one aggregate over the judged list.

    ``ranked([by], query_id, rank, rel)``; ``totals(query_id, n_relevant)`` lists the queries to
    report, including those for which nothing was retrieved.  ``grid`` gives the ``by`` combinations
    (a parameter table); without it they are taken from ``ranked``.  Undefined values are null.
    """
    k_grid = [k for k in k_grid if k > 0]
    keys = [*by, "query_id"]
    gain = 1.0 / F.log2(F.col("rank") + 1)
    sums = []
    for k in k_grid:
        inside = (F.col("rank") <= k) & (F.col("rel") == 1)
        sums += [F.sum(F.when(inside, 1).otherwise(0)).alias(f"h{k}"), F.sum(F.when(inside, gain).otherwise(0.0)).alias(f"d{k}")]
    first = F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first")
    per_query = ranked.groupBy(*keys).agg(*sums, first)

    if by:
        combos = grid if grid is not None else ranked.select(*by).distinct()
        values = F.collect_set(F.struct(*by)).alias("combos")
        base = totals.select("query_id", "n_relevant", F.explode(combos.agg(values).scalar()).alias("g"))
        base = base.select("query_id", "n_relevant", *[F.col(f"g.{c}").alias(c) for c in by])
    else:
        base = totals.select("query_id", "n_relevant")
    joined = base.join(per_query, keys, "left")
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                F.coalesce(f"h{k}", F.lit(0)).alias("hits"),
                F.coalesce(f"d{k}", F.lit(0.0)).alias("dcg"),
            )
            for k in k_grid
        ]
    )
    rows = joined.select(*keys, "n_relevant", "first", F.explode(cells).alias("c")).select(
        *keys, "n_relevant", "first", "c.*"
    )
    total = F.col("n_relevant")
    precision = F.col("hits") / F.col("k")
    recall = F.when(total > 0, F.col("hits") / total)
    reciprocal = F.when(F.col("first") <= F.col("k") if cut_reciprocal else F.col("first").isNotNull(), 1.0 / F.col("first"))
    return rows.select(
        *keys,
        "k",
        precision.alias("precision"),
        recall.alias("recall"),
        F.when(total > 0, F.when(F.col("hits") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)).alias("f1"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.when(total > 0, F.col("dcg") / _ideal_dcg(total, F.col("k"), max(k_grid))).alias("ndcg"),
        F.col("dcg"),
        F.coalesce(reciprocal, F.lit(0.0)).alias("reciprocal_rank"),
    )


def _one(ranked: DataFrame, totals: DataFrame | None, k: int, name: str) -> DataFrame:
    if totals is None:
        totals = ranked.groupBy("query_id").agg(F.lit(None).cast("long").alias("n_relevant"))
    if k <= 0:
        return totals.select("query_id", F.lit(None).cast("double").alias(name))
    return query_metrics(ranked, totals, [k]).select("query_id", rounded(F.col(name)).alias(name))


def precision_at_k(ranked: DataFrame, k: int) -> DataFrame:
    """Hits in the top k over k, also for lists shorter than k."""
    return _one(ranked, None, k, "precision")


def recall_at_k(ranked: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """Hits in the top k over all relevant; null when nothing is relevant."""
    return _one(ranked, totals, k, "recall")


def f1_at_k(ranked: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """Harmonic mean of precision and recall; 0 without hits, null when recall is null."""
    return _one(ranked, totals, k, "f1")


def hit_at_k(ranked: DataFrame, k: int) -> DataFrame:
    """1.0 when the top k hold a relevant chunk."""
    return _one(ranked, None, k, "hit")


def dcg_at_k(ranked: DataFrame, k: int) -> DataFrame:
    return _one(ranked, None, k, "dcg")


def ndcg_at_k(ranked: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    return _one(ranked, totals, k, "ndcg")


def reciprocal_rank(ranked: DataFrame) -> DataFrame:
    """1 over the first relevant rank in the whole list, 0 without one."""
    first = F.min(F.when(F.col("rel") == 1, F.col("rank")))
    return ranked.groupBy("query_id").agg(rounded(F.coalesce(1.0 / first, F.lit(0.0))).alias("reciprocal_rank"))


def mean_defined(df: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean over defined values (neither null nor NaN); null when there is none."""
    value = F.when(~F.isnan(F.col(metric)), F.col(metric))
    return df.groupBy(*by).agg(rounded(F.avg(value)).alias(f"mean_{metric}"))


# --- grids ---------------------------------------------------------------------------------------


def metric_grid(
    ranked: DataFrame,
    labels: DataFrame,
    k_grid: Sequence[int] = rules.K_GRID,
    by: Sequence[str] = ("alpha",),
    grid: DataFrame | None = None,
    splits: DataFrame | None = None,
    cut_reciprocal: bool = False,
) -> DataFrame:
    """Mean metrics per parameter combination and k over answerable queries.

    With ``splits(query_id, favors, category, ...)`` the same pass also reports every split value, by
    grouping sets: ``split_by`` is ``overall`` or the split column's name.
    """
    totals = labels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    per_query = query_metrics(judged(ranked, labels), totals, k_grid, by, grid, cut_reciprocal)
    names = [c for c in splits.columns if c != "query_id"] if splits is not None else []
    if names:
        missing = [F.coalesce(F.col(c), F.lit("?")).alias(c) for c in names]
        per_query = per_query.join(splits.select("query_id", *missing), "query_id", "left")
    keys = [*by, "k"]
    means = [rounded(F.avg(m)).alias(m) for m in METRICS]
    aggregates = [*means, rounded(F.avg("reciprocal_rank")).alias("mrr"), F.count(F.lit(1)).alias("n")]
    if not names:
        return per_query.groupBy(*keys).agg(*aggregates)
    sets = [[F.col(c) for c in keys]] + [[F.col(c) for c in [*keys, s]] for s in names]
    grouped = per_query.groupingSets(sets, *[F.col(c) for c in [*keys, *names]]).agg(
        *aggregates, *[F.grouping(s).alias(f"_g_{s}") for s in names]
    )
    label, value = F.lit("overall"), F.lit("all")
    for s in names:
        label = F.when(F.col(f"_g_{s}") == 0, F.lit(s)).otherwise(label)
        value = F.when(F.col(f"_g_{s}") == 0, F.col(s)).otherwise(value)
    return grouped.select(label.alias("split_by"), value.alias("split_value"), *keys, *METRICS, "mrr", "n")


def pick_alpha(grid: DataFrame, k: int = rules.K_SELECT) -> DataFrame:
    """The weight with the best (recall, f1) at ``k``; ties go to the smallest weight."""
    best = F.max_by("alpha", F.struct("recall", "f1", -F.col("alpha")))
    return grid.filter(F.col("k") == k).agg(best.alias("alpha"))


def saturation_k(
    grid: DataFrame,
    k_column: str = "k",
    by: Sequence[str] = ("alpha",),
    max_k: int = rules.MAX_K,
    share: float = rules.SATURATION,
) -> DataFrame:
    """Smallest k that reaches ``share`` of the recall at ``max_k``; ``max_k`` when that recall is 0."""
    ceiling = grid.filter(F.col(k_column) == max_k).select(*by, F.col("recall").alias("_max"))
    joined = grid.join(ceiling, list(by)) if by else grid.withColumn("_max", ceiling.select("_max").scalar())
    enough = (F.col("_max") > 0) & (F.col("recall") >= share * F.col("_max"))
    return joined.groupBy(*by).agg(
        F.coalesce(F.min(F.when(enough, F.col(k_column))), F.lit(max_k)).alias("saturation_k")
    )


def rerank_curve(
    reranked: DataFrame, baseline: DataFrame, labels: DataFrame, n_max: int = rules.RERANK_CURVE_N
) -> DataFrame:
    """Metrics for n = 1..n_max after reranking and for the unreranked order."""
    both = reranked.select("query_id", "chunk_id", "rank", F.lit("rerank").alias("variant")).unionByName(
        baseline.select("query_id", "chunk_id", "rank", F.lit("baseline").alias("variant"))
    )
    variants = reranked.sparkSession.createDataFrame([("rerank",), ("baseline",)], "variant string")
    return metric_grid(both, labels, range(1, n_max + 1), by=("variant",), grid=variants)


def pick_n(curve: DataFrame) -> DataFrame:
    """n with the best f1 after reranking; ties go to the smallest."""
    best = F.max_by("k", F.struct("f1", -F.col("k")))
    return curve.filter(F.col("variant") == "rerank").agg(best.alias("n"))


def depth_simulation(
    hybrid: DataFrame,
    reranked: DataFrame,
    labels: DataFrame,
    topk_grid: Sequence[int] = rules.TOPK_GRID,
    topn_grid: Sequence[int] = rules.TOPN_GRID,
) -> DataFrame:
    """Metrics for every (top_k, top_n): the rerank order restricted to the first top_k candidates.

    One full rerank serves all depths.  Reciprocal ranks are cut at top_n here.
    """
    from pyspark.sql import Window

    depth = F.explode(F.array(*[F.lit(k) for k in topk_grid])).alias("top_k")
    both = hybrid.select("query_id", "chunk_id", F.col("rank").alias("hybrid_rank")).join(
        reranked.select("query_id", "chunk_id", F.col("rank").alias("rerank_rank")), ["query_id", "chunk_id"]
    )
    within = both.select("*", depth).filter(F.col("hybrid_rank") <= F.col("top_k"))
    order = Window.partitionBy("top_k", "query_id").orderBy("rerank_rank")
    lists = within.select(
        "top_k", "query_id", "chunk_id", F.lit("rerank").alias("variant"), F.row_number().over(order).alias("rank")
    ).unionByName(
        within.select("top_k", "query_id", "chunk_id", F.lit("baseline").alias("variant"), F.col("hybrid_rank").alias("rank"))
    )
    combos = hybrid.sparkSession.createDataFrame(
        [(k, v) for k in topk_grid for v in ("rerank", "baseline")], "top_k int, variant string"
    )
    out = metric_grid(lists, labels, topn_grid, by=("top_k", "variant"), grid=combos, cut_reciprocal=True)
    return out.withColumnRenamed("k", "top_n")


def pick_depth(simulation: DataFrame, focus: int = rules.TOPN_FOCUS) -> DataFrame:
    """top_k with the best (f1, recall) at the focus top_n; ties go to the smallest."""
    rows = simulation.filter((F.col("variant") == "rerank") & (F.col("top_n") == focus))
    return rows.agg(F.max_by("top_k", F.struct("f1", "recall", -F.col("top_k"))).alias("top_k"))


def simulation_check(real: DataFrame, simulated: DataFrame, depth: int = 5) -> DataFrame:
    """Per query whether the first ``depth`` chunks agree in content and order."""

    def heads(df: DataFrame, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
        return (
            df.filter(F.col("rank") <= depth)
            .groupBy("query_id")
            .agg(F.transform(ordered, lambda s: s["chunk_id"]).alias(name))
        )

    return heads(real, "real").join(heads(simulated, "sim"), "query_id").select(
        "query_id", (F.col("real") == F.col("sim")).alias("match")
    )


# --- agreement -----------------------------------------------------------------------------------


def label_pairs(labels_a: DataFrame, labels_b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Pair two label sets by key; a key missing on one side is an error, raised when the rows are read."""
    both = labels_a.select(*key, "a").join(labels_b.select(*key, "b"), list(key), "full")
    missing = F.col("a").isNull() | F.col("b").isNull()
    checked = lambda c: F.when(missing, F.raise_error(F.lit("label sets do not have the same keys")).cast("int")).otherwise(F.col(c))
    return both.select(*key, checked("a").alias("a"), checked("b").alias("b"))


def _agreement_columns() -> dict[str, Column]:
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    po = F.avg((F.col("a") == F.col("b")).cast("double"))
    pa_, pb = F.avg(a), F.avg(b)
    pe = pa_ * pb + (1 - pa_) * (1 - pb)
    kappa = F.when(pe >= 1.0, F.when(po >= 1.0, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return {
        "kappa": rounded(kappa),
        "n_pairs": F.count(F.lit(1)),
        "raw_agreement": rounded(po),
        "a_pos_rate": rounded(pa_),
        "b_pos_rate": rounded(pb),
    }


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """Chance-corrected agreement of two 0/1 columns ``a`` and ``b``; null without rows."""
    return pairs.agg(_agreement_columns()["kappa"].alias("kappa"))


def agreement_report(pairs: DataFrame) -> DataFrame:
    """Kappa, number of pairs, raw agreement and both positive rates."""
    return pairs.agg(*[c.alias(n) for n, c in _agreement_columns().items()])


def pool_pairs(pooled: DataFrame, auto: DataFrame, judged_labels: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Pool pairs with an external label, next to the automatic one; excluded queries are left out."""
    pairs = pooled if excluded is None else pooled.join(excluded.select("query_id"), "query_id", "left_anti")
    return (
        pairs.join(judged_labels.select("query_id", "chunk_id", F.col("relevant").cast("int").alias("b")), ["query_id", "chunk_id"])
        .join(auto.select("query_id", "chunk_id", F.lit(1).alias("_a")), ["query_id", "chunk_id"], "left")
        .select("query_id", "chunk_id", F.coalesce("_a", F.lit(0)).alias("a"), "b")
    )


# --- external judgments --------------------------------------------------------------------------


def parse_label_json(text: Column | str, field: str = "relevant") -> Column:
    """Truth of ``field`` in a JSON reply: the whole text, else its outermost {...}, else a literal match."""
    raw = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)^\s+|\s+$", "")

    def truth(candidate: Column) -> Column:
        doc = F.try_parse_json(candidate)
        is_object = F.startswith(F.schema_of_variant(doc), F.lit("OBJECT"))
        value = F.try_variant_get(doc, f"$.{field}", "variant")
        kind = F.schema_of_variant(value)
        plain = F.get_json_object(candidate, f"$.{field}")
        falsy = (
            F.when(kind.isNull() | (kind == "VOID"), True)
            .when(kind == "STRING", plain == "")
            .when(kind == "BOOLEAN", plain == "false")
            .when(F.rlike(kind, F.lit("^(OBJECT|ARRAY)")), plain.isin("{}", "[]"))
            .otherwise(plain.try_cast("double") == 0)
        )
        return F.when(doc.isNotNull() & is_object, ~F.coalesce(falsy, F.lit(False)))

    low = F.lower(bare)
    said = lambda word: F.contains(low, F.lit(f'"{field}": {word}')) | F.contains(low, F.lit(f'"{field}":{word}'))
    return F.coalesce(
        truth(bare),
        truth(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))),
        F.when(said("true"), True).when(said("false"), False),
    )


def pending_pairs(pairs: DataFrame, cache: DataFrame, key: Sequence[str] = ("query_id", "chunk_id")) -> DataFrame:
    """Pairs that have no cached judgment yet."""
    return pairs.join(cache.select(*key), list(key), "left_anti")


def merge_judgments(
    cache: DataFrame, judged_now: DataFrame, requested: DataFrame, key: Sequence[str] = ("query_id", "chunk_id")
) -> tuple[DataFrame, DataFrame]:
    """(new cache, labels of the requested pairs).

    Failed judgments (null) are not cached.  A pair that the cache holds keeps its judgment.
    """
    fresh = judged_now.filter(F.col("relevant").isNotNull()).join(cache.select(*key).distinct(), list(key), "left_anti")
    grown = cache.select(*key, "relevant").unionByName(fresh.select(*key, "relevant"))
    return grown, grown.join(requested.select(*key), list(key), "left_semi")


# --- score tables --------------------------------------------------------------------------------


def score_summary(evaluations: DataFrame, by: Sequence[str] = ("run_id", "metric")) -> DataFrame:
    """Mean score per run and metric; null and NaN scores are skipped."""
    score = F.when(~F.isnan("score"), F.col("score"))
    return evaluations.groupBy(*by).agg(
        rounded(F.avg(score)).alias("mean_score"), F.count(score).alias("n_scores")
    )


def run_compare(summary: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """Per metric the two means and their difference, in one aggregate over the summary."""
    pick = lambda run: F.max(F.when(F.col("run_id") == run, F.col("mean_score")))
    return summary.groupBy("metric").agg(
        pick(run_a).alias("score_a"), pick(run_b).alias("score_b"), rounded(pick(run_b) - pick(run_a)).alias("delta")
    )


def route_tally(routes: DataFrame) -> DataFrame:
    """Counts and shares per predicted class, and how many were sent directly although they needed search.

    ``routes(predicted, needs_search)``.
    """
    counts = routes.groupBy("predicted").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when((F.col("predicted") == "direct") & F.col("needs_search"), 1).otherwise(0)).alias("false_direct"),
    )
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("predicted", "n", rounded(F.col("n") / total).alias("share"), "false_direct")
