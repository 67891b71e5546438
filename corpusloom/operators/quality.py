"""Data quality checks over chunks and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusloom import rules
from corpusloom.functions.text import is_blank, null_if_blank


def chunk_flags(chunks: DataFrame, chunk_size: int = rules.CHUNK_SIZE) -> DataFrame:
    """Add ``flags``, the integrity problems of each chunk."""
    content = F.coalesce("content", F.lit(""))
    context = null_if_blank("context")
    table = F.coalesce("has_table", F.lit(False))
    no_grid = F.coalesce(F.size("grid"), F.lit(0)) <= 0
    no_path = F.coalesce(F.size("heading_path"), F.lit(0)) <= 0
    checks = [
        F.when(is_blank(content), "EMPTY_CONTENT"),
        F.when(table & no_grid, "TABLE_NO_DATA").when(table & ~F.contains(content, F.lit("|")), "TABLE_MD_MISMATCH"),
        F.when(context.isNotNull() & F.contains(content, context), "CONTEXT_IN_CONTENT"),
        F.when(F.coalesce("token_count", F.lit(0)) > 3 * chunk_size, "TOKEN_OUTLIER"),
        F.when(F.col("vector_id").isNull(), "VECTOR_ID_NULL"),
        F.when(~table & no_path, "HEADING_EMPTY"),
    ]
    return chunks.withColumn("flags", F.array_compact(F.array(*checks)))


def seeded_sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Exactly ``n`` rows, the same for the same seed; all rows when n <= 0 or there are not more.

    Ordering by a seeded hash of the key is a top-n, so every task sends at most n rows.
    """
    if n <= 0:
        return rows
    return rows.orderBy(F.md5(F.concat_ws("/", F.lit(seed), F.col(key)).cast("binary")), F.col(key)).limit(n)


def flag_report(flagged: DataFrame, heavy: Sequence[str] = rules.HEAVY_FLAGS) -> DataFrame:
    """Count and whole percent of rows per flag, and whether the flag fails the gate.

    All rows are counted in the same pass, under a null flag beside the others; the window runs over one
    row per kind of flag.
    """
    marks = F.array_append(F.coalesce("flags", F.array().cast("array<string>")), F.lit(None).cast("string"))
    counts = flagged.select(F.explode(marks).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    total = F.max(F.when(F.col("flag").isNull(), F.col("n"))).over(Window.partitionBy())
    shares = counts.withColumn("percent", F.floor(F.col("n") * 100 / total).cast("long")).filter(F.col("flag").isNotNull())
    return shares.select("flag", "n", "percent", F.col("flag").isin(*heavy).alias("heavy")).orderBy(F.col("n").desc(), "flag")


def passes_gate(flagged: DataFrame, heavy: Sequence[str] = rules.HEAVY_FLAGS) -> DataFrame:
    """One row: number of rows with a heavy flag and whether the gate passes."""
    bad = F.arrays_overlap("flags", F.array(*[F.lit(h) for h in heavy]))
    hits = F.coalesce(F.sum(bad.cast("long")), F.lit(0))
    return flagged.agg(hits.alias("heavy_rows"), (hits == 0).alias("passed"))


def unique_violations(df: DataFrame, rule: str, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (null keys are not compared)."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    counts = df.filter(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return counts.select(F.lit(rule).alias("rule"), name.alias("key"), "n")


def domain_violations(df: DataFrame, rule: str, key: str, allowed: Column) -> DataFrame:
    """Rows whose value is outside the allowed set; null passes, as in a check constraint."""
    return df.filter(~F.coalesce(allowed, F.lit(True))).select(
        F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.lit(1).cast("long").alias("n")
    )


def foreign_key_violations(child: DataFrame, parent: DataFrame, rule: str, child_key: str, parent_key: str) -> DataFrame:
    """Child keys without a parent.  Children are reduced to distinct keys before the join."""
    used = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    lost = used.join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col("_k").cast("string").alias("key"), "n")


def check_table(
    rows: DataFrame,
    unique: Mapping[str, Sequence[str]] | None = None,
    domains: Mapping[str, tuple[Sequence[str], Column]] | None = None,
    references: Mapping[str, tuple[Sequence[str], DataFrame]] | None = None,
) -> DataFrame:
    """All rules of one table from one scan: (rule, key, n).

    ``unique`` maps rules to key columns: keys found n > 1 times.  ``domains`` maps rules to key columns
    and a condition: keys with n rows for which it is false (null passes).  ``references`` maps rules to
    columns and a parent with as many columns: values that n rows hold and no parent row does.  Keys are
    written with "/" between their parts; unique keys and references with a null part are not compared,
    and a null part of a domain rule's key stays empty.  Every row becomes at most one item per rule, all
    items are counted in one grouped pass with a map-side part, and one anti join serves all references.
    """
    unique, domains, references = unique or {}, domains or {}, references or {}
    if len({*unique, *domains, *references}) < len(unique) + len(domains) + len(references):
        raise ValueError("every rule needs a name of its own")
    present = lambda keys: reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    # Parts are compared as an array, so that "a/b" and "c" differ from "a" and "b/c".
    parts = lambda keys: F.array(*[F.col(k).cast("string") for k in keys])
    item = lambda rule, keys: F.struct(F.lit(rule).alias("rule"), parts(keys).alias("parts"))
    items = [F.when(present(keys), item(rule, keys)) for rule, keys in unique.items()]
    items += [F.when(~F.coalesce(allowed, F.lit(True)), item(rule, keys)) for rule, (keys, allowed) in domains.items()]
    items += [F.when(present(keys), item(rule, keys)) for rule, (keys, _) in references.items()]
    dealt = rows.select(F.explode(F.array_compact(F.array(*items))).alias("i")).select("i.rule", "i.parts")
    counts = dealt.groupBy("rule", "parts").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter(~F.col("rule").isin(*unique) | (F.col("n") > 1)) if unique else counts
    if references:
        parents = [p.select(F.lit(rule).alias("rule"), parts(p.columns).alias("parts")) for rule, (_, p) in references.items()]
        counts = counts.join(reduce(DataFrame.unionByName, parents), ["rule", "parts"], "left_anti")
    key = F.array_join(F.transform("parts", lambda p: F.coalesce(p, F.lit(""))), "/")
    return counts.select("rule", key.alias("key"), "n")


def observe_rules(rows: DataFrame, domains: Mapping[str, Column], name: str = "rules") -> tuple[DataFrame, Observation]:
    """``rows`` as they are, with a count of all rows and of each rule's violations made as they pass.

    The counts (``rows`` and one per rule) stand in the observation after the first action on the result,
    such as its writing, and cost no scan.  Null passes a rule.
    """
    seen = Observation(name)
    counts = [F.count_if(~F.coalesce(allowed, F.lit(True))).alias(rule) for rule, allowed in domains.items()]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen


def constraint_report(violations: Sequence[DataFrame]) -> DataFrame:
    """All violations in one table (rule, key, n)."""
    return reduce(DataFrame.unionByName, violations)


def write_reconciliation(expected: DataFrame, written: DataFrame, key: str = "doc_id", item: str = "vector_id") -> DataFrame:
    """Per document how many expected items were not written; any missing one fails the document."""
    missing = expected.join(written.select(item), item, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("missing"))
    return missing.select(key, "missing", F.lit("failed").alias("status"))


def content_presence(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Whether a document has any page text or block: ``pages(key, md, n_blocks)``."""
    has = F.bool_or((F.coalesce("md", F.lit("")) != "") | (F.coalesce("n_blocks", F.lit(0)) > 0))
    return pages.groupBy(key).agg(F.count(F.lit(1)).alias("page_count"), has.alias("has_content"))
