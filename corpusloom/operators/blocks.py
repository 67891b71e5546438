"""Blocks, heading paths, segments and chunks.

A parsed document is one row with ``blocks array<struct<page_number,type,level,value,md,rows>>`` in
reading order, just as a parser delivers it.  The operators are row-local: they need no shuffle, and no
document can become a hot group, because its text is already bounded by its own row.  One walk over each
document's numbers (kinds, levels, tokens), in Arrow batches, finds where segments and pieces begin; texts
stay in the JVM and are cut and joined there, in time proportional to the document.  Only results are
exploded into tables.  Documents too long for a row come as block rows and are walked in a sorted stream.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom import rules
from corpusloom.functions import text as T
from corpusloom.functions.markup import BLOCK
from corpusloom.functions.text import let

# Task code travels with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRID = "array<array<string>>"
LOCATED = BLOCK[:-1] + ",path:array<string>>"
CHUNK = (
    "struct<content:string,context:string,heading_path:array<string>,chunk_type:string,"
    f"has_table:boolean,page_number:int,grid:{GRID}>"
)
#: Chunks of a batch that is handed on, and the characters at which it is handed on earlier.
OUT_ROWS, OUT_CHARS = 4096, 4 << 20
GROUP = "struct<blocks:array<int>,heading_path:array<string>,context:string,chunk_type:string>"


# --- normalization -------------------------------------------------------------------------------


def normalize_items(items: Column, page_number: Column) -> Column:
    """Parser items of one page as blocks; unsupported and empty items are dropped."""

    def grid(item: Column) -> Column:
        cell = lambda c: F.nullif(T.py_strip(c), F.lit(""))
        return F.when(item["type"] == "table", F.transform(item["rows"], lambda r: F.transform(r, cell)))

    def one(item: Column) -> Column:
        md = F.nullif(T.py_strip(item["md"]), F.lit(""))
        value = F.nullif(T.py_strip(item["value"]), F.lit(""))
        return F.struct(
            page_number.cast("int").alias("page_number"),
            item["type"].alias("type"),
            item["lvl"].cast("int").alias("level"),
            F.coalesce(value, md, F.lit("")).alias("value"),
            F.coalesce(md, value, F.lit("")).alias("md"),
            grid(item).cast(GRID).alias("rows"),
        ).cast(BLOCK)

    known = F.filter(items, lambda x: x["type"].isin("heading", "text", "table"))
    return F.filter(
        F.transform(F.coalesce(known, F.array().cast(known_type(items))), one),
        lambda b: (b["md"] != "") | (F.coalesce(F.size(b["rows"]), F.lit(0)) > 0),
    )


ITEM_IN = f"struct<type:string,lvl:int,value:string,md:string,rows:{GRID}>"


def known_type(_: Column) -> str:
    return f"array<{ITEM_IN}>"


def normalize_blocks(docs: DataFrame, pages: str = "pages") -> DataFrame:
    """Add ``blocks`` and ``page_texts`` to documents with ``pages array<struct<page,md,items>>``.

    The page number is the parser's, or the 1-based position when that is missing or zero.
    """
    numbered = F.transform(
        F.col(pages),
        lambda p, i: F.struct(
            F.coalesce(F.nullif(p["page"].cast("int"), F.lit(0)), i + 1).alias("page_number"),
            F.coalesce(T.py_strip(p["md"]), F.lit("")).alias("md"),
            p["items"].alias("items"),
        ),
    )
    return docs.withColumn("_pages", numbered).select(
        *[c for c in docs.columns if c != pages],
        F.transform("_pages", lambda p: F.struct(p["page_number"], p["md"])).alias("page_texts"),
        F.flatten(F.transform("_pages", lambda p: normalize_items(p["items"], p["page_number"]))).alias("blocks"),
    )


# --- the walk ------------------------------------------------------------------------------------

TEXT, HEADING, OPENING, TABLE = range(4)
WALK = "open array<array<int>>, head array<int>, items array<int>, pieces array<int>, piece_items array<int>"


class Walk:
    """What one pass carries from block to block: open headings, tokens of the segment and of the piece.

    A heading closes every level that is not above its own.  A table stands alone; a run of other blocks is cut before
    a heading once it holds ``region_max`` tokens.  Inside a run, a block that would take a piece beyond
    ``chunk_size`` tokens begins another one; no block is split.
    """

    def __init__(self, region_max: int, chunk_size: int) -> None:
        self.region_max, self.chunk_size = region_max, chunk_size
        self.levels: list[int] = []
        self.open: list = []
        self.run, self.piece, self.fresh = 0, 0, True

    def step(self, kind: int, level: int, tokens: int, heading: object) -> tuple[bool, bool]:
        """Whether the block begins a segment (or table), and whether it begins a piece."""
        if kind == OPENING:
            while self.levels and self.levels[-1] >= level:
                self.levels.pop()
                self.open.pop()
            self.levels.append(level)
            self.open.append(heading)
        table = kind == TABLE
        item = self.fresh or table or (kind != TEXT and self.run >= self.region_max)
        self.run = 0 if table else tokens if item else self.run + tokens
        piece = item or self.piece + tokens > self.chunk_size
        self.piece = tokens if piece else self.piece + tokens
        self.fresh = table
        return item, piece


def _walker(region_max: int, chunk_size: int) -> Callable[[Column, Column, Column], Column]:
    """One walk per document over three arrays of numbers; texts stay where they are."""

    def run(kinds: pd.Series, levels: pd.Series, tokens: pd.Series) -> pd.DataFrame:
        rows = []
        for ks, ls, ts in zip(kinds, levels, tokens):
            walk, opened, head, items, pieces, piece_items = Walk(region_max, chunk_size), [], [], [], [], []
            for i, (k, level, t) in enumerate(zip(ks.tolist(), ls.tolist(), ts.tolist())):
                item, piece = walk.step(k, level, t, i)
                if k == OPENING:
                    opened.append(list(walk.open))
                head.append(len(opened) - 1)
                if item:
                    items.append(i)
                if piece:
                    pieces.append(i)
                    piece_items.append(items[-1])
            rows.append((opened, head, items, pieces, piece_items))
        return pd.DataFrame(rows, columns=["open", "head", "items", "pieces", "piece_items"])

    return F.pandas_udf(run, WALK)


def with_walk(docs: DataFrame, region_max: int = rules.REGION_MAX_TOKENS, chunk_size: int = rules.CHUNK_SIZE) -> DataFrame:
    """Add ``_bs`` (the blocks, never null), ``_tokens`` and ``_walk`` to documents.

    ``_walk`` holds, as places of blocks: the open headings after each heading with a text, each block's number among
    these headings (-1 for none), the first blocks of segments and tables, those of pieces, and each piece's segment.
    """
    opens = lambda b: (b["type"] == "heading") & (F.coalesce(b["value"], F.lit("")) != "")
    kind = lambda b: F.when(b["type"] == "table", TABLE).when(opens(b), OPENING).when(b["type"] == "heading", HEADING).otherwise(TEXT)
    level = lambda b: F.coalesce(F.nullif(b["level"], F.lit(0)), F.lit(1))
    named = docs.withColumn("_bs", F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>")))
    counted = named.withColumn("_tokens", F.transform("_bs", lambda b: T.count_tokens(b["md"])))
    return counted.withColumn("_walk", _walker(region_max, chunk_size)(F.transform("_bs", kind), F.transform("_bs", level), F.col("_tokens")))


def path_at(place: Column) -> Column:
    """Heading path in force at a block of a walked document (a heading belongs to its own path)."""
    none = F.array().cast("array<string>")
    head = F.get(F.col("_walk.head"), place)
    return F.when(head >= 0, F.transform(F.get(F.col("_walk.open"), head), lambda h: F.get(F.col("_bs"), h)["value"])).otherwise(none)


def _slices(array: Column, starts: Column, build: Callable[[Column, Column, Column], Column]) -> Column:
    """``build(slice, start, number)`` for the slices of ``array`` that begin at the 0-based ``starts``."""
    return F.transform(starts, lambda s, j: build(F.slice(array, s + 1, F.coalesce(F.get(starts, j + 1), F.size(array)) - s), s, j))


# --- heading paths and segments ------------------------------------------------------------------


def _located(walked: DataFrame) -> DataFrame:
    """Replace ``_bs`` by blocks with their heading path."""
    fields = ("page_number", "type", "level", "value", "md", "rows")
    named = F.transform("_bs", lambda b, i: F.struct(*[b[f].alias(f) for f in fields], path_at(i).alias("path")).cast(LOCATED))
    return walked.withColumn("_bs", named)


def heading_path(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per block with its position and heading path."""
    return T.unnest(_located(with_walk(docs)), [key], F.col("_bs"), "pos", "b").select(
        key, "pos", "b.page_number", "b.type", "b.level", "b.value", "b.md", "b.rows", F.col("b.path").alias("heading_path")
    )


def segment_blocks(docs: DataFrame, key: str = "doc_id", region_max: int = rules.REGION_MAX_TOKENS) -> DataFrame:
    """One row per segment (tables excluded) with its page, heading path, token count and blocks."""

    def segment(part: Column, start: Column, number: Column) -> Column:
        first = F.element_at(part, 1)
        tokens = F.slice("_tokens", start + 1, F.size(part))
        return F.struct(
            (first["type"] == "table").alias("is_table"),
            first["page_number"].alias("page_number"),
            first["path"].alias("path"),
            F.aggregate(tokens, F.lit(0), lambda a, b: a + b).alias("tokens"),
            part.alias("blocks"),
        )

    walked = _located(with_walk(docs, region_max))
    items = F.filter(_slices(F.col("_bs"), F.col("_walk.items"), segment), lambda x: F.coalesce(~x["is_table"], F.lit(True)))
    return T.unnest(walked, [key], items, "segment_index", "s").select(
        key, "segment_index", "s.page_number", F.col("s.path").alias("heading_path"), "s.tokens", "s.blocks"
    )


# --- merging -------------------------------------------------------------------------------------


def _greedy(chunk_size: int) -> Callable[[Column], Column]:
    """Places at which pieces begin, from the tokens of a segment's texts."""

    def run(tokens: pd.Series) -> pd.Series:
        out = []
        for ts in tokens:
            walk = Walk(0, chunk_size)
            out.append(None if ts is None else [i for i, t in enumerate(ts.tolist()) if walk.step(TEXT, 1, t, None)[1]])
        return pd.Series(out)

    return F.pandas_udf(run, "array<int>")


def merged_texts(texts: Column, chunk_size: int = rules.CHUNK_SIZE) -> Column:
    """Greedy merge of neighbouring texts up to a soft token limit; a text is never split."""
    starts = _greedy(chunk_size)(F.transform(texts, T.count_tokens))

    def body(both: Column) -> Column:
        ts = both["texts"]
        merged = _slices(ts, both["starts"], lambda part, start, number: F.array_join(part, "\n\n"))
        return F.when(F.size(ts) <= 1, F.filter(ts, lambda t: ~T.is_blank(t))).otherwise(merged)

    return let(F.struct(texts.alias("texts"), starts.alias("starts")), body)


def merge_blocks(segments: DataFrame, chunk_size: int = rules.CHUNK_SIZE) -> DataFrame:
    """One row per merged piece of each segment."""
    texts = F.transform("blocks", lambda b: b["md"])
    keep = [c for c in segments.columns if c not in ("blocks", "tokens")]
    return T.unnest(segments, keep, merged_texts(texts, chunk_size), "piece_index", "content")


def grouping_gate(
    segments: DataFrame, enabled: bool = True, min_tokens: int = rules.GROUPING_MIN_TOKENS
) -> DataFrame:
    """Mark the segments for which proposed block groups are considered."""
    total = T.count_tokens(F.array_join(F.transform("blocks", lambda b: b["md"]), "\n\n"))
    return segments.withColumn(
        "use_groups", F.lit(enabled) & (F.size("blocks") > 1) & (total > min_tokens)
    )


# --- proposed groups -----------------------------------------------------------------------------


def partition_problem(groups: Column, n_blocks: Column) -> Column:
    """Null when the groups partition 0..n-1 into consecutive runs, else the first reason found.

    Blocks in several groups are found as neighbours in the sorted list of all (block, group).
    """
    none = F.array().cast("array<int>")

    def own(g: Column, n: Column) -> Column:
        ids = g["blocks"]
        first = F.get(ids, F.lit(0))
        return (
            F.when(F.coalesce(F.size(ids), F.lit(0)) <= 0, "group without blocks")
            .when(F.exists(ids, lambda i: (i < 0) | (i >= n)), "block out of range")
            .when(F.exists(F.transform(ids, lambda x, j: x - first - j), lambda d: d != 0), "blocks not consecutive")
        )

    def again(placed: Column) -> Column:
        met = F.transform(placed, lambda x, j: F.when(F.get(placed, j - 1)["id"] == x["id"], x["g"]))
        return F.array_min(met)

    def check(both: Column) -> Column:
        gs, n = both["groups"], both["n"]
        ids = F.flatten(F.transform(gs, lambda g, j: F.transform(F.coalesce(g["blocks"], none), lambda i: F.struct(i.alias("id"), j.alias("g")))))
        found = F.struct(
            F.transform(gs, lambda g: own(g, n)).alias("own"), let(F.array_sort(ids), again).alias("again"), F.size(ids).alias("covered"), n.alias("n")
        )

        def first(f: Column) -> Column:
            bad = F.array_min(F.transform(f["own"], lambda p, j: F.when(p.isNotNull(), j)))
            ahead = bad.isNotNull() & (f["again"].isNull() | (bad <= f["again"]))
            return (
                F.when(ahead, F.get(f["own"], bad))
                .when(f["again"].isNotNull(), F.lit("block in several groups"))
                .when(f["covered"] != f["n"], F.lit("blocks not covered"))
            )

        return let(found, first)

    empty = F.coalesce(F.size(groups), F.lit(0)) <= 0
    return F.when(empty, F.lit("no groups")).otherwise(let(F.struct(groups.alias("groups"), n_blocks.alias("n")), check))


def validate_partition(proposals: DataFrame, groups: str = "groups", n_blocks: str = "n_blocks") -> DataFrame:
    """Add ``problem`` (null when valid) and ``valid``."""
    checked = proposals.withColumn("problem", partition_problem(F.col(groups), F.col(n_blocks)))
    return checked.withColumn("valid", F.col("problem").isNull())


def assemble_groups(
    segments: DataFrame,
    proposals: DataFrame,
    key: str = "doc_id",
    chunk_size: int = rules.CHUNK_SIZE,
    doc_name: str | None = None,
) -> DataFrame:
    """Chunks of each segment: the proposed groups when they are a valid partition, else the greedy merge.

    ``proposals(key, segment_index, groups)`` holds at most one row per segment, so the join is one to
    one and AQE may broadcast the proposal side when it is small.
    """
    name = F.col(doc_name) if doc_name else F.lit(None).cast("string")
    joined = segments.join(proposals.select(key, "segment_index", "groups"), [key, "segment_index"], "left")
    gated = grouping_gate(joined)
    problem = partition_problem(F.col("groups"), F.size("blocks"))
    ready = gated.withColumn("accepted", F.col("use_groups") & F.col("groups").isNotNull() & problem.isNull())

    def from_group(g: Column) -> Column:
        picked = F.transform(g["blocks"], lambda i: F.get(F.col("blocks"), i))
        content = F.array_join(F.transform(picked, lambda b: b["md"]), "\n\n")
        path = F.coalesce(T.clean_path(g["heading_path"]), F.col("heading_path"))
        return F.struct(
            content.alias("content"),
            F.coalesce(T.null_if_blank(g["context"]), T.heading_context(path, name, F.lit(None).cast("string"))).alias("context"),
            path.alias("heading_path"),
            F.when(g["chunk_type"].isin(*rules.PROPOSED_CHUNK_TYPES), g["chunk_type"])
            .otherwise(T.chunk_type(content))
            .alias("chunk_type"),
            F.lit(False).alias("has_table"),
            F.element_at(picked, 1)["page_number"].alias("page_number"),
            F.lit(None).cast(GRID).alias("grid"),
        ).cast(CHUNK)

    fallback = _segment_chunks(
        F.transform("blocks", lambda b: b["md"]), F.col("heading_path"), F.col("page_number"), name, F.lit(None).cast("string"), chunk_size
    )
    chunks = F.when(F.col("accepted"), F.transform("groups", from_group)).otherwise(fallback)
    return T.unnest(ready, [key, "segment_index", "accepted"], chunks, "piece_index", "c").select(
        key, "segment_index", "piece_index", "accepted", "c.*"
    )


# --- whole documents -----------------------------------------------------------------------------


def _segment_chunks(
    texts: Column, path: Column, page: Column, doc_name: Column, filename: Column, chunk_size: int
) -> Column:
    def one(content: Column) -> Column:
        return F.struct(
            content.alias("content"),
            T.heading_context(path, doc_name, filename).alias("context"),
            path.alias("heading_path"),
            T.chunk_type(content).alias("chunk_type"),
            F.lit(False).alias("has_table"),
            page.alias("page_number"),
            F.lit(None).cast(GRID).alias("grid"),
        ).cast(CHUNK)

    return F.transform(F.filter(merged_texts(texts, chunk_size), lambda t: ~T.is_blank(t)), one)


def _table_chunk(block: Column, path: Column, doc_name: Column, filename: Column) -> Column:
    return F.struct(
        F.coalesce(block["md"], F.lit("")).alias("content"),
        T.heading_context(path, doc_name, filename, rules.CONTEXT_WORDING["table"]).alias("context"),
        path.alias("heading_path"),
        F.lit("table").alias("chunk_type"),
        F.lit(True).alias("has_table"),
        block["page_number"].alias("page_number"),
        block["rows"].alias("grid"),
    ).cast(CHUNK)


def _has_table_content(block: Column) -> Column:
    return ~T.is_blank(block["md"]) | (F.coalesce(F.size(block["rows"]), F.lit(0)) > 0)


def _name_columns(docs: DataFrame, filename: str | None, doc_name: str | None) -> tuple[Column, Column]:
    none = F.lit(None).cast("string")
    file_col = F.col(filename) if filename else none
    name_col = F.coalesce(F.col(doc_name), file_col) if doc_name else file_col
    return name_col, file_col


def table_chunks(
    docs: DataFrame, key: str = "doc_id", filename: str | None = None, doc_name: str | None = None
) -> DataFrame:
    """Every table of a document as its own chunk; a table with neither text nor grid is skipped."""
    name, file_col = _name_columns(docs, filename, doc_name)
    tables = F.filter("_walk.items", lambda i: let(F.get("_bs", i), lambda b: (b["type"] == "table") & _has_table_content(b)))
    chunks = F.transform(tables, lambda i: _table_chunk(F.get("_bs", i), path_at(i), name, file_col))
    return T.unnest(with_walk(docs), [key], chunks, "table_index", "c").select(key, "table_index", "c.*")


def build_chunks(
    docs: DataFrame,
    key: str = "doc_id",
    filename: str | None = None,
    doc_name: str | None = None,
    carry: tuple[str, ...] = (),
    chunk_size: int = rules.CHUNK_SIZE,
    region_max: int = rules.REGION_MAX_TOKENS,
) -> DataFrame:
    """Blocks to final chunks: heading paths, segments, tables, greedy merge, context, ids.

    ``carry`` columns (filter metadata) are copied onto every chunk.  One walk over each document's numbers finds the
    cuts, the rest is one narrow projection followed by an explode.
    """
    name, file_col = _name_columns(docs, filename, doc_name)

    def piece(part: Column, start: Column, number: Column) -> Column:
        first, item = F.element_at(part, 1), F.get(F.col("_walk.piece_items"), number)
        table = F.coalesce(first["type"] == "table", F.lit(False))
        content = F.when(table, F.coalesce(first["md"], F.lit(""))).otherwise(F.array_join(F.transform(part, lambda b: b["md"]), "\n\n"))
        return F.struct(
            content.alias("content"),
            path_at(item).alias("path"),
            table.alias("has_table"),
            F.get(F.col("_bs"), item)["page_number"].alias("page_number"),
            F.when(table, first["rows"]).alias("grid"),
        )

    found = F.filter(
        _slices(F.col("_bs"), F.col("_walk.pieces"), piece),
        lambda c: ~T.is_blank(c["content"]) | (c["has_table"] & (F.coalesce(F.size(c["grid"]), F.lit(0)) > 0)),
    )
    return _chunk_rows(with_walk(docs, region_max, chunk_size), key, carry, found, name, file_col)


def _chunk_rows(docs: DataFrame, key: str, carry: tuple[str, ...], found: Column, name: Column, file_col: Column) -> DataFrame:
    """Chunks of each document exploded, with context, type, text and ids."""
    columns = [key, *carry, name.alias("_name"), file_col.alias("_file")]
    rows = T.unnest(docs.select(*columns, found.alias("_found")), [key, *carry, "_name", "_file"], F.col("_found"), "chunk_index", "c")
    return _finished(rows.select(key, *carry, "_name", "_file", "chunk_index", "c.*"), key, carry)


def _finished(rows: DataFrame, key: str, carry: tuple[str, ...]) -> DataFrame:
    """Context, type, text and ids of chunks with ``content, path, has_table, page_number, grid``."""
    extra = F.when(F.col("has_table"), F.lit(rules.CONTEXT_WORDING["table"]))
    described = rows.select(
        key,
        *carry,
        "chunk_index",
        "content",
        T.heading_context(F.col("path"), F.col("_name"), F.col("_file"), extra).alias("context"),
        F.col("path").alias("heading_path"),
        F.when(F.col("has_table"), "table").otherwise(T.chunk_type("content")).alias("chunk_type"),
        "has_table",
        "page_number",
        F.col("grid").cast(GRID).alias("grid"),
    )
    return described.withColumn("text", T.contextual_text("context", "content")).select(
        "*", T.count_tokens("text").alias("token_count"), T.chunk_uuid(key, "chunk_index").alias("chunk_id"), T.document_uuid(key).alias("document_ref")
    )


def chunk_block_rows(
    blocks: DataFrame,
    key: str = "doc_id",
    pos: str = "pos",
    filename: str | None = None,
    doc_name: str | None = None,
    carry: tuple[str, ...] = (),
    chunk_size: int = rules.CHUNK_SIZE,
    region_max: int = rules.REGION_MAX_TOKENS,
) -> DataFrame:
    """The chunks of ``build_chunks`` for documents whose blocks are rows, in the order of ``pos``.

    For documents too long for one row.  Blocks are dealt by document and sorted; a task walks over its Arrow batches
    and holds open headings, counts and the texts of one piece, whatever the length of the document.
    ``blocks(key, pos, page_number, type, level, value, md, rows, carry...)``.
    """
    name, file_col = _name_columns(blocks, filename, doc_name)
    opens = (F.col("type") == "heading") & (F.coalesce("value", F.lit("")) != "")
    kind = F.when(F.col("type") == "table", TABLE).when(opens, OPENING).when(F.col("type") == "heading", HEADING).otherwise(TEXT)
    level = F.coalesce(F.nullif("level", F.lit(0)), F.lit(1)).cast("int")
    marked = blocks.select(
        F.col(key).alias("_key"),
        F.struct(*carry, name.alias("_name"), file_col.alias("_file")).alias("_carry"),
        F.col(pos).alias("_pos"),
        kind.alias("_kind"),
        level.alias("_level"),
        T.count_tokens("md").alias("_tokens"),
        T.is_blank("md").alias("_blank"),
        F.col("page_number").cast("int").alias("_page"),
        F.when(opens, F.col("value")).alias("_value"),
        "md",
        F.col("rows").cast(GRID).alias("_rows"),
    )
    stream = marked.repartition("_key").sortWithinPartitions("_key", "_pos").drop("_pos")
    kept = [stream.schema["_key"], stream.schema["_carry"]]
    out = ST.StructType(kept + ST._parse_datatype_string(f"chunk_index int, content string, path array<string>, has_table boolean, page_number int, grid {GRID}").fields)
    schema = to_arrow_schema(out)

    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, of_key in groupby(rows, lambda r: (r[0],)):
            walk, index, piece, path, page = Walk(region_max, chunk_size), 0, [], [], None
            for row in of_key:
                item, fresh = walk.step(*row[2:5], row[7])
                if fresh and piece:
                    done = _piece_row(piece, index, path, page)
                    if done:
                        yield done
                        index += 1
                    piece = []
                if item:
                    path, page = list(walk.open), row[6]
                piece.append(row)
            done = _piece_row(piece, index, path, page)
            if done:
                yield done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, chars = [], 0
        for row in pieces(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            waiting.append(row)
            chars += len(row[3])
            if chars > OUT_CHARS or len(waiting) >= OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)
                waiting, chars = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)

    rows = stream.mapInArrow(run, out)
    return _finished(rows.select(F.col("_key").alias(key), "_carry.*", *[c for c in rows.columns if c not in ("_key", "_carry")]), key, carry)


def _piece_row(piece: list[tuple], index: int, path: list[str], page: int | None) -> tuple | None:
    """key, carried columns, index, content, path, has_table, page_number, grid of a piece; None for one without content."""
    key, carried, kind, _, _, _, _, _, md, grid = piece[0]
    table = kind == TABLE
    if all(r[5] for r in piece) and not (table and grid):
        return None
    content = (md or "") if table else "\n\n".join(r[8] for r in piece if r[8] is not None)
    return key, carried, index, content, path, table, page, grid if table else None


def ingest_summary(docs: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Status of every document: ready with counts, or failed with a reason.

    ``docs(key, page_count, has_content[, error])``; a given ``error`` wins.  Chunks are counted with a
    map-side partial aggregate before the join.
    """
    counted = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    error = F.col("error") if "error" in docs.columns else F.lit(None).cast("string")
    reason = F.coalesce(
        error,
        F.when(~F.col("has_content"), F.lit("no content")),
        F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, F.lit("no chunks")),
    )
    return (
        docs.join(counted, key, "left")
        .withColumn("_reason", F.substring(reason, 1, rules.MAX_ERROR_CHARS))
        .select(
            key,
            F.when(F.col("_reason").isNull(), "ready").otherwise("failed").alias("status"),
            F.when(F.col("_reason").isNull(), F.col("page_count")).alias("page_count"),
            F.when(F.col("_reason").isNull(), F.col("n")).alias("chunk_count"),
            F.col("_reason").alias("error_message"),
        )
    )
