"""Array functions that take time in proportion to the array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let

#: Numbers that one append fold sums up; larger arrays are summed block by block.
BLOCK = 256


def _running(numbers: Column, first: Column) -> Column:
    """``first`` and then the sum after each number but the last."""
    none = F.array().cast("array<bigint>")
    start = F.struct(none.alias("sums"), first.cast("bigint").alias("total"))
    done = F.aggregate(
        numbers,
        start,
        lambda acc, n: F.struct(F.concat(acc["sums"], F.array(acc["total"])).alias("sums"), (acc["total"] + n).alias("total")),
    )
    return done["sums"]


def running_sums(numbers: Column, block: int = BLOCK) -> Column:
    """For each number the sum of those before it.

    Appending copies what is there, so one fold over the whole array would take quadratic time.  Blocks are
    summed on their own and start at the running sums of the blocks before them.
    """

    def in_blocks(whole: Column) -> Column:
        blocks = F.transform(
            F.when(F.size(whole) > 0, F.sequence(F.lit(0), F.size(whole) - 1, F.lit(block))).otherwise(F.array().cast("array<int>")),
            lambda i: F.slice(whole, i + 1, F.lit(block)),
        )
        sums = lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda total, n: total + n)
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, _running(F.transform(bs, sums), F.lit(0)), _running)))

    return let(F.transform(numbers, lambda n: n.cast("bigint")), in_blocks)


def matches(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` in ``text``, in order: start, end (code points, end exclusive) and the matched text.

    The pattern must not match the empty string.  Texts without a match are only searched once.
    """
    kind = "array<struct<start:bigint,end:bigint,text:string>>"

    def located(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        pieces = F.arrays_zip(F.split(t, pattern, -1).alias("before"), found.alias("text"))
        some = F.filter(pieces, lambda p: p["text"].isNotNull())
        return let(
            some,
            lambda ps: F.zip_with(
                ps,
                running_sums(F.transform(ps, lambda p: F.char_length(p["before"]) + F.char_length(p["text"]))),
                lambda p, at: F.struct(
                    (at + F.char_length(p["before"])).alias("start"),
                    (at + F.char_length(p["before"]) + F.char_length(p["text"])).alias("end"),
                    p["text"].alias("text"),
                ),
            ),
        ).cast(kind)

    return F.when(text.rlike(pattern), located(text)).otherwise(F.array().cast(kind))
