"""Ordered work inside groups of any size.

A window over one key runs in one task, so a key with a third of all rows would decide the run time.
These helpers cut each group into sections along its order column, work per (key, section) and carry a
small summary from section to section.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], section: Column, out: str = "pos") -> DataFrame:
    """0-based position of every row in its group's order.

    ``section`` must not decrease along the order.  Sections are counted first (map-side), their offsets
    are summed over the counts only, and rows are numbered inside their section.
    """
    cut = df.withColumn("_section", section)
    counts = cut.groupBy(*keys, "_section").agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy(*keys).orderBy("_section").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_section", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_section").orderBy(*order)
    numbered = cut.withColumn("_row", F.row_number().over(inside))
    joined = numbered.join(offsets, [*keys, "_section"])
    return joined.withColumn(out, (F.col("_offset") + F.col("_row") - 1).cast("long")).drop("_section", "_offset", "_row", "_count")


def preceding_rows(df: DataFrame, keys: Sequence[str], pos: str, n: int, value: Column, out: str, block: int = 4096) -> DataFrame:
    """The up to ``n`` preceding values of every row, in order, as an array.

    Rows are grouped by (key, position block); the last ``n`` rows of a block also visit the next one,
    so no group is larger than ``block + n`` rows.
    """
    block = max(block, n)
    here = F.floor(F.col(pos) / block)
    visits = F.when(F.col(pos) % block >= block - n, F.array(here, here + 1)).otherwise(F.array(here))
    spread = df.withColumn("_value", value).withColumn("_home", here).withColumn("_block", F.explode(visits))
    frame = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(-n, -1)
    filled = spread.withColumn(out, F.collect_list("_value").over(frame))
    return filled.filter(F.col("_home") == F.col("_block")).drop("_value", "_home", "_block")
