"""Mixing sources to target weights along a time-varying curriculum.

Targets.  Sources share the words of the mix by weight; a source may give at most ``max_epochs`` times its
own words, and what it can't give goes to the others by weight (``source_targets``).

Positions.  Each source has a schedule, its relative weight at times 0 to 1, linear between the given
points.  Its integral, scaled to the target, is the source's cumulative demand for words.  Documents of a
source stand in an order given by a hash; the middle of document d in pass r lies at some number of words;
the time at which the demand reaches that number is the position of this copy (``training_positions``).
Copies whose middle lies beyond the target are not taken, so a source's words are within one document of
its target.  Sorting by position range gives the training order.

Running sums never gather a source in one task: documents fall into slices of the hash, the slices' sums
are added up first, and then the documents within a slice.

Defined cases: a null text has size 0; documents of size 0 are taken once if their place lies below the
target.  A null source is a source, ordered last.  Rows with equal ids are ordered by their text, equal
rows by an arbitrary but harmless order (they are alike).  An empty table gives no rows.  Other columns are
kept by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, free_name
from corpusloom.session import materialize

# The weights of the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Relative weight of a source over time, by its place in the order of sources, repeating: the first rises,
#: the second stays, the third falls.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 0.8), (1.0, 0.9)))
#: Joined to a document's id before hashing: another text, another order.
ORDER = "|mix"
#: Documents that a slice of the order should hold.
SLICE_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle(values: tuple, place: Column) -> Column:
    """The value for a place, the values repeating."""
    return F.get(F.array(*(F.lit(v) for v in values)), (place % len(values)).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Of (source, size): source, place, source_size, weight, target.  One row for each source.

    A level L gives each source min(weight * L, max_epochs * size).  Sources stop in the order of
    max_epochs * size / weight; the level is the one at which all words are shared.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1)
    full = F.lit(float(max_epochs)) * F.col("source_size")
    ranked = placed.withColumn("weight", cycle(weights, F.col("place"))).withColumn("full_at", full / F.col("weight"))
    order = Window.orderBy("full_at", "place")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(rest))
    # the sources before the first one that its level does not fill are full, all others stand at that level
    level = F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "place", "level"))).over(every)["level"]
    target = F.when(F.col("weight") * F.coalesce("common", F.col("full_at")) < full, F.col("weight") * F.col("common")).otherwise(full)
    return levels.withColumn("common", level).select("source", F.col("place").cast("long").alias("place"), "source_size", "weight", target.alias("target"))


def demand_time(share: Column, schedule: tuple) -> Column:
    """The time at which the integral of a schedule reaches a share (0 to 1) of its whole."""
    pieces = [(t0, w0, t1, w1, (t1 - t0) * (w0 + w1) / 2) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    whole, done, time = sum(p[4] for p in pieces), 0.0, F.lit(1.0)
    branches = []
    for t0, w0, t1, w1, area in pieces:
        left, slope = share * whole - done, (w1 - w0) / (t1 - t0)
        # left = w0 * x + slope * x^2 / 2, in the form that also holds for slope 0
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * left, F.lit(0.0)))
        branches.append((share * whole <= done + area, t0 + 2 * left / (w0 + root)))
        done += area
    for condition, value in reversed(branches):
        time = F.when(condition, value).otherwise(time)
    return F.least(F.greatest(time, F.lit(0.0)), F.lit(1.0))


def training_positions(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, schedules: tuple = SCHEDULES) -> DataFrame:
    """doc_id, version (hash of the text), source, size, source_size, target, positions (one time for each copy taken)."""
    sized = docs.select("doc_id", F.xxhash64("text").alias("version"), "source", word_count(F.col("text")).alias("size"))
    sized = materialize(sized.withColumn("key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(ORDER)).cast("binary"))), "sizes")
    # slices of the hash's first 32 bits: a power of two of them, so that each holds about SLICE_ROWS documents of all sources
    bits = (sized.count() // SLICE_ROWS).bit_length()
    sliced = sized.withColumn("slice", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits))
    targets = source_targets(sized, weights, max_epochs)
    running = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = sliced.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    bases = bases.select("source", "slice", F.coalesce(F.sum("slice_size").over(running), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "version").rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    s, b, t = placed.alias("s"), bases.alias("b"), targets.alias("t")
    joined = (
        s.join(b, F.col("s.source").eqNullSafe(F.col("b.source")) & (F.col("s.slice") == F.col("b.slice")))
        .join(t, F.col("s.source").eqNullSafe(F.col("t.source")))
        .select("s.doc_id", "s.version", "s.source", "s.size", "t.place", "t.source_size", "t.target", (F.col("b.base") + F.col("s.inside") + F.col("s.size") / 2).alias("middle"))
    )

    def time(passed: Column) -> Column:
        share = F.when(F.col("target") > 0, (F.col("middle") + passed * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))
        kinds = [demand_time(share, x) for x in schedules]
        return F.get(F.array(*kinds), (F.col("place") % len(schedules)).cast("int"))

    passes = F.filter(F.array(*(F.lit(r) for r in range(max_epochs))), lambda r: F.col("middle") + r * F.col("source_size") <= F.col("target"))
    return joined.withColumn("positions", F.transform(passes, time)).drop("middle", "place")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix in training order: each document as often as it is taken, with all its columns."""
    version, position = free_name(docs, "_version"), free_name(docs, "_position")
    placed = training_positions(docs, **options).groupBy("doc_id", "version").agg(F.max("positions").alias("positions"))
    d, p = docs.withColumn(version, F.xxhash64("text")).alias("d"), placed.alias("p")
    found = d.join(p, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col(f"d.{version}") == F.col("p.version")))
    copies = found.select(*(F.col(f"d.`{c}`") for c in docs.columns), F.explode("p.positions").alias(position))
    return copies.repartitionByRange(position, "doc_id").sortWithinPartitions(position, "doc_id").select(*docs.columns)
