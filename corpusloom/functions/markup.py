"""Page markup to ordered blocks: one tokenizer with an element stack, linear in the page."""

from __future__ import annotations

import html
import re
import sys
from collections import Counter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, _parse_datatype_string

from corpusloom.functions.text import Cols, _c, py_strip

# Task code travels with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = (
    "struct<page_number:int,type:string,level:int,value:string,md:string,rows:array<array<string>>>"
)

# --- fixed values: element classes ---------------------------------------------------------------
_DROPPED = frozenset("script style nav footer head template title".split())
_RAW = frozenset("script style title".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HEADINGS = {f"h{i}": i for i in range(1, 7)}
_BREAKING = frozenset(
    "p div article section main body html ul ol li dl dt dd blockquote pre figure figcaption form fieldset hr address table thead tbody tfoot "
    "tr td th caption header aside noscript template nav footer head".split()
)
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")
#: A tag: a quoted value only opens after "=", any other quote is a character of a name or value.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}


def _characters(text: str) -> str:
    return _REFERENCE.sub(lambda m: html.unescape(m[0]), text) if "&" in text else text


def _lines(pieces: list[str | None]) -> list[str]:
    """Lines of text between line breaks (None), with single blanks, without empty ones."""
    out, line = [], []
    for piece in [*pieces, None]:
        if piece is not None:
            line.append(piece)
            continue
        tidy = " ".join("".join(line).split())
        if tidy:
            out.append(tidy)
        line = []
    return out


class PageWalk:
    """Blocks of one page.

    Text is cut at block elements; a heading reaches to its end or to the next block element.  Dropped elements
    hide what they hold, also nested ones, until they or an element around them end.  A table is one grid: tables inside it
    are text of its cells, and its text outside cells (a caption) comes before it.
    """

    def __init__(self) -> None:
        self.blocks: list[dict] = []
        self.text: list[str | None] = []
        self.level: int | None = None
        self.open: list[str] = []
        self.count: Counter[str] = Counter()
        self.hidden = 0
        self.tables = 0
        self.rows: list[list[str | None]] = []
        self.cell: list[str | None] | None = None

    def block(self, kind: str, level: int | None, value: str, md: str, rows: list | None) -> None:
        self.blocks.append({"page_number": 1, "type": kind, "level": level, "value": value, "md": md, "rows": rows})

    def say(self, text: str | None) -> None:
        """Text, or None for a line break."""
        if not self.hidden:
            (self.text if self.cell is None else self.cell).append(text)

    def cut(self) -> None:
        """End of a piece of text."""
        if self.cell is not None:
            self.cell.append(None)
            return
        value = "\n".join(_lines(self.text))
        if value and self.level:
            self.block("heading", self.level, value, "#" * self.level + " " + value, None)
        elif value:
            self.block("text", None, value, value, None)
        self.text, self.level = [], None

    def end_cell(self) -> None:
        if self.cell is not None:
            self.rows[-1].append(" ".join(_lines(self.cell)) or None)
            self.cell = None

    def end_table(self) -> None:
        self.end_cell()
        self.cut()
        if self.rows:
            line = lambda row: "| " + " | ".join(c or "" for c in row) + " |"
            rule = "| " + " | ".join("---" for _ in self.rows[0]) + " |"
            md = "\n".join([line(self.rows[0]), rule, *map(line, self.rows[1:])])
            self.block("table", None, md, md, self.rows)
        self.rows, self.tables = [], 0

    def start(self, name: str) -> None:
        if name == "body" and self.count["head"]:
            self.end("head")
        if name in _BREAKING and not self.hidden:
            if name == "table":
                if self.tables == 0:
                    self.cut()
                self.tables += 1
            if self.tables == 1 and name == "tr":
                self.end_cell()
                self.rows.append([])
            elif self.tables == 1 and name in ("td", "th"):
                self.end_cell()
                if not self.rows:
                    self.rows.append([])
                self.cell = []
            else:
                self.cut()
        if name in _HEADINGS and not self.hidden:
            self.cut()
            self.level = _HEADINGS[name] if self.cell is None else None
        if name == "br":
            self.say(None)
        if name not in _VOID:
            self.open.append(name)
            self.count[name] += 1
            self.hidden += name in _DROPPED

    def end(self, name: str) -> None:
        if not self.count[name]:
            if name in _BREAKING and not self.hidden and not self.tables:
                self.cut()
            return
        while True:
            last = self.open.pop()
            self.count[last] -= 1
            self.hidden -= last in _DROPPED
            if not self.hidden and last not in _DROPPED:
                self.close(last)
            elif not self.hidden:
                self.cut()
            if last == name:
                return

    def close(self, name: str) -> None:
        if name == "table" and self.tables:
            if self.tables == 1:
                self.end_table()
            else:
                self.tables -= 1
                self.cut()
        elif self.tables == 1 and name in ("tr", "td", "th"):
            self.end_cell()
        elif name in _BREAKING or name in _HEADINGS:
            self.cut()

    def finish(self) -> list[dict]:
        if self.tables:
            self.end_table()
        self.cut()
        return self.blocks


def page_blocks(markup: str) -> list[dict]:
    """Blocks of a page, read once from left to right."""
    walk, at, n = PageWalk(), 0, len(markup)
    while at < n:
        mark = markup.find("<", at)
        if mark < 0:
            walk.say(_characters(markup[at:]))
            break
        if mark > at:
            walk.say(_characters(markup[at:mark]))
        after = markup[mark + 1 : mark + 3]
        tag = _TAG.match(markup, mark) if after[:1].isalpha() or after[:1] == "/" and after[1:].isalpha() else None
        if tag:
            at, name = tag.end(), tag[2].lower()
            if tag[1]:
                walk.end(name)
                continue
            walk.start(name)
            if name in _RAW:
                close = _ENDS[name].search(markup, at)
                at = close.start() if close else n
        elif markup.startswith("<!--", mark):
            close = markup.find("-->", mark + 4)
            at = close + 3 if close >= 0 else n
        elif after[:1] in ("!", "?", "/") or after[:1].isalpha():
            # a declaration, or a tag that never ends
            close = markup.find(">", mark)
            at = close + 1 if close >= 0 else n
        else:
            walk.say("<")
            at = mark + 1
    return walk.finish()


def _block_type() -> DataType:
    return ArrayType(_parse_datatype_string(BLOCK))


def html_blocks(markup: Cols) -> Column:
    """Ordered heading, text and table blocks of a page, without scripts, styles, templates, navigation and footer.

    Null gives null.  A tag that never ends takes the rest of the page, as in a browser; a "<" that begins no tag is text.
    """
    kind = _block_type()
    arrow = to_arrow_type(kind)

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else page_blocks(p) for p in pages.to_pylist()], arrow)

    return F.arrow_udf(run, kind)(_c(markup))


def _block(kind: Column, level: Column, value: Column, md: Column, rows: Column) -> Column:
    return F.struct(
        F.lit(1).alias("page_number"),
        kind.alias("type"),
        level.alias("level"),
        value.alias("value"),
        md.alias("md"),
        rows.alias("rows"),
    ).cast(BLOCK)


def text_blocks(text: Cols) -> Column:
    """Lines of plain or Markdown text as blocks; ``#`` lines are headings, blank lines are skipped."""
    lines = F.filter(F.split(_c(text), "\n"), lambda x: F.rlike(x, F.lit(r"(?U)\S")))

    def one(line: Column) -> Column:
        md = py_strip(line)
        hashes = F.regexp_extract(md, r"^(#{1,6})\s+\S", 1)
        heading = hashes != ""
        value = F.when(heading, F.regexp_replace(md, r"^#{1,6}\s+", "")).otherwise(md)
        return _block(
            F.when(heading, "heading").otherwise("text"),
            F.when(heading, F.length(hashes)),
            value,
            md,
            F.lit(None).cast("array<array<string>>"),
        )

    return F.transform(lines, one)
