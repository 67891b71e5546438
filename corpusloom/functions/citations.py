"""Sentence and citation-marker functions on one answer per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import Cols, _c, is_blank

SENTENCE = "struct<id:int,text:string,delim:string,cited:array<int>>"
# A piece ends at a run of newlines or at whitespace that follows end punctuation, or at the end.
_PIECE = r"(?sU)(.*?)(\n+|(?<=[.!?…])\s+|\z)"


def cited_indices(text: Cols) -> Column:
    """Every ``[n]`` in order."""
    found = F.regexp_extract_all(_c(text), F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def split_sentences(answer: Cols) -> Column:
    """Array of sentences with their trailing delimiter; joining text and delimiters rebuilds the answer.

    A blank piece belongs to the delimiter of the sentence before it; a leading blank piece is lost.
    """
    raw = _c(answer)
    pieces = F.arrays_zip(
        F.regexp_extract_all(raw, F.lit(_PIECE), F.lit(1)).alias("text"),
        F.regexp_extract_all(raw, F.lit(_PIECE), F.lit(2)).alias("delim"),
    )

    def step(done: Column, piece: Column) -> Column:
        text, delim = piece["text"], piece["delim"]
        last = F.element_at(done, -1)
        glued = F.struct(
            last["id"].alias("id"),
            last["text"].alias("text"),
            F.concat(last["delim"], text, delim).alias("delim"),
            last["cited"].alias("cited"),
        )
        fresh = F.struct(
            F.size(done).alias("id"),
            text.alias("text"),
            delim.alias("delim"),
            cited_indices(text).alias("cited"),
        )
        return (
            F.when(~is_blank(text), F.concat(done, F.array(fresh.cast(SENTENCE))))
            .when(F.size(done) == 0, done)
            .otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(glued.cast(SENTENCE))))
        )

    return F.aggregate(pieces, F.array().cast(f"array<{SENTENCE}>"), step)


def recite(text: Cols, indices: Column) -> Column:
    """Replace all markers of a sentence by the given ones, placed before its end punctuation."""
    core = F.regexp_replace(_c(text), r"\[\d+\]", "")
    marker = F.array_join(F.transform(indices, lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), "")
    tail = F.regexp_extract(core, r"(?U)([.!?…]+)\s*$", 1)
    head = F.regexp_replace(core, r"(?U)[.!?…]+\s*$", "")
    right_strip = lambda c: F.regexp_replace(c, r"(?U)\s+$", "")
    return (
        F.when(F.coalesce(F.size(indices), F.lit(0)) <= 0, right_strip(F.regexp_replace(core, r"(?U)\s{2,}", " ")))
        .when(tail != "", F.concat(right_strip(head), F.lit(" "), marker, tail))
        .otherwise(F.concat(right_strip(core), F.lit(" "), marker))
    )


def outermost_json(text: Cols) -> Column:
    """The outermost {...} of a reply, without a code fence; the text itself when there is none."""
    from corpusloom.functions.text import py_strip

    bare = py_strip(F.coalesce(_c(text), F.lit("")))
    unfenced = F.when(
        F.startswith(bare, F.lit("```")),
        F.regexp_replace(F.regexp_replace(bare, r"^```[a-zA-Z]*\n?", ""), r"(?s)```(?!.*```).*$", ""),
    ).otherwise(bare)
    inner = F.regexp_extract(unfenced, r"(?s)(\{.*\})", 1)
    return F.when(inner != "", inner).otherwise(unfenced)


def delta_pct(current: Cols, previous: Cols) -> Column:
    """Percent change to one decimal, null without a previous value."""
    cur, prev = _c(current), _c(previous)
    return F.when(prev != 0, F.round((cur - prev) / prev * 100, 1))
