"""Text of web pages as a reader sees it.

A small tree builder makes elements of the tags, with the end tags that HTML implies, and leaves out what is
not shown: scripts, styles, templates, hidden elements.  Formulas are shown without their annotations, and of
drawings the text elements.  Rendering keeps the layout: blocks on lines of
their own, blank lines around paragraphs, headings, lists and tables, bullets and numbers with indentation,
preformatted text as it stands, and table cells padded to columns.

Defined cases: a null or empty page has an empty text; unclosed and stray tags are closed or passed over;
pages are taken one by one, so repeated rows give repeated results; other columns are not looked at.
Tables more than ``TABLE_DEPTH`` deep are laid out as blocks; nothing of their text is lost.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Names of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
NOT_SHOWN = frozenset("head script style template noscript iframe object embed noembed noframes title datalist audio video canvas".split())
#: Not shown inside a formula, and inside a drawing.
NOT_IN_MATH = frozenset("annotation annotation-xml mphantom".split())
NOT_IN_SVG = frozenset("title desc metadata defs symbol marker pattern clippath mask style script".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote hr figure".split())
BLOCKS = SPACED | frozenset(
    "html body address article aside center dd details dialog dir div dt fieldset figcaption footer form header hgroup legend li main menu nav optgroup option search section summary tr caption".split()
)
CLOSES_P = (BLOCKS - frozenset("html body li dd dt option optgroup tr caption".split())) | {"li", "dd", "dt"}
#: What an opening tag closes, up to the elements that bar it.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
TABLE_DEPTH = 8

# A quote opens a value only directly after '='; one that nothing closes, and any other, is a character like others.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*+)((?>[\s/]+|[^\s/>][^\s/>=]*+(?>\s*=\s*(?>\"[^\"]*\"|'[^']*'|[^\s>]*))?)*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)")


class Element:
    __slots__ = ("name", "attributes", "children", "shown")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []
        style = attributes.get("style", "").lower()
        self.shown = name not in NOT_SHOWN and "hidden" not in attributes and not (style and HIDDEN_STYLE.search(style)) and not (name == "input")


def parse(source: str) -> Element:
    """The tree of a page."""
    root = Element("#root", {})
    path, at = [root], 0

    def text(part: str) -> None:
        if part:
            path[-1].children.append(html.unescape(part))

    def close(names: set[str], bars: set[str]) -> None:
        for k in range(len(path) - 1, 0, -1):
            if path[k].name in names:
                del path[k:]
                return
            if path[k].name in bars:
                return

    while found := TOKEN.search(source, at):
        text(source[at : found.start()])
        at = found.end()
        if closing := found[1]:
            name = closing.lower()
            if name == "p" and not any(e.name == "p" for e in path):
                path[-1].children.append(Element("p", {}))
            elif name == "br":
                path[-1].children.append(Element("br", {}))
            else:
                close({name}, set() if name in ("table", "body", "html") else {"table"} if name in ("tr", "tbody", "thead", "tfoot", "td", "th", "caption") else {"td", "th", "table"})
        elif opening := found[2]:
            name, rest = opening.lower(), found[3]
            attributes = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)} if rest.strip("/ \n\t") else {}
            if name in ("html", "body") and any(e.name == name for e in path):
                continue
            if name in CLOSES_P:
                close({"p"}, {"table", "td", "th", "button", "object"})
            if name in ("tr", "thead", "tbody", "tfoot"):
                close({"td", "th"}, {"table", "tr"})
            if name in ("thead", "tbody", "tfoot"):
                close({"tr"}, {"table"})
            if name in IMPLIED:
                close(*IMPLIED[name])
            if name not in VOID and path[-1].name == "head" and name not in ("title", "style", "script", "noscript", "template"):
                path.pop()
            element = Element(name, attributes)
            if name in NOT_IN_MATH and any(e.name == "math" for e in path):
                element.shown = False
            path[-1].children.append(element)
            if name in RAW and not (rest.endswith("/") and any(e.name in ("svg", "math") for e in path)):
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                stop = end.start() if end else len(source)
                if name in ("textarea", "xmp"):
                    element.children.append(html.unescape(source[at:stop]) if name == "textarea" else source[at:stop])
                at = (source.find(">", stop) + 1 or len(source)) if end else len(source)
            elif name not in VOID and not rest.rstrip().endswith("/") or name in BLOCKS and name not in VOID:
                path.append(element)
    text(source[at:])
    return root


def drawn(svg: Element) -> list[Element | str]:
    """The parts of a drawing that hold text, in order, with blanks between them."""
    out, todo = [], svg.children[::-1]
    while todo:
        node = todo.pop()
        if isinstance(node, str) or node.name in NOT_IN_SVG or not node.shown:
            continue
        if node.attributes.get("display") == "none" or node.attributes.get("visibility") in ("hidden", "collapse"):
            continue
        if node.name in ("text", "foreignobject"):
            out += [" ", node]
        else:
            todo.extend(reversed(node.children))
    return [*out, " "] if out else out


class Page:
    """Lines of a rendered part of a page."""

    def __init__(self, depth: int = 0):
        self.lines: list[str] = []
        self.depth, self.line, self.blank, self.indent, self.label, self.pre, self.gap = depth, [], False, [""], "", 0, False

    def end_line(self) -> None:
        if "".join(self.line).strip() or self.label and self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.lines.append((self.indent[-1][: len(self.indent[-1]) - len(self.label)] + self.label + "".join(self.line)).rstrip())
            self.blank, self.label = False, ""
        self.line, self.gap = [], False

    def space(self) -> None:
        self.end_line()
        self.blank = True

    def write(self, text: str) -> None:
        if self.pre:
            first, *more = text.split("\n")
            self.line.append(first)
            for part in more:
                if not "".join(self.line).strip() and self.lines and not self.blank:
                    self.lines.append("")
                self.end_line()
                self.line.append(part)
            return
        words = text.split()
        if not words:
            self.gap = self.gap or bool(text)
            return
        if self.line and (self.gap or text[0].isspace()):
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.gap = text[-1].isspace()

    def render(self, top: Element) -> None:
        """Walk the tree without recursion; tables are rendered apart."""
        numbers: list[int | None] = []
        todo: list[tuple[bool, Element | str]] = [(True, top)]
        while todo:
            enter, node = todo.pop()
            if isinstance(node, str):
                self.write(node)
                continue
            name = node.name
            if enter:
                if not node.shown:
                    continue
                if name == "br":
                    if self.line:
                        self.end_line()
                    else:
                        self.blank = True
                    continue
                if name == "hr":
                    self.space()
                    self.line.append("---")
                    self.space()
                    continue
                if name == "table" and self.depth < TABLE_DEPTH:
                    self.space()
                    for line in table_lines(node, self.depth + 1):
                        self.line.append(line)
                        self.end_line()
                    self.space()
                    continue
                nested = name in ("ul", "ol", "menu", "dir") and bool(numbers)
                if name in SPACED and not nested:
                    self.space()
                elif name in BLOCKS:
                    self.end_line()
                elif name in ("td", "th", "mtd"):
                    self.gap = True
                elif name == "math" and node.attributes.get("display") == "block":
                    self.end_line()
                if name in ("ul", "menu", "dir"):
                    numbers.append(None)
                elif name == "ol":
                    start = node.attributes.get("start", "1")
                    numbers.append(int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1)
                elif name == "li":
                    label = "- "
                    if numbers and numbers[-1] is not None:
                        label, numbers[-1] = f"{numbers[-1]}. ", numbers[-1] + 1
                    self.label = label
                    self.indent.append(self.indent[-1] + " " * len(label))
                elif name in ("dd", "blockquote"):
                    self.indent.append(self.indent[-1] + "  ")
                elif name in ("pre", "textarea", "xmp"):
                    self.pre += 1
                todo.append((False, node))
                children = drawn(node) if name == "svg" else node.children
                if name == "mfrac":
                    children = [x for c in children for x in (c, " ")]
                todo.extend((True, c) for c in reversed(children))
            else:
                if name in ("pre", "textarea", "xmp"):
                    self.end_line()
                    self.pre -= 1
                nested = name in ("ul", "ol", "menu", "dir") and len(numbers) > 1
                if name in SPACED and not nested:
                    self.space()
                elif name in BLOCKS or name == "math" and node.attributes.get("display") == "block":
                    self.end_line()
                if name in ("ul", "ol", "menu", "dir"):
                    numbers.pop()
                elif name == "li":
                    self.indent.pop()
                    self.label = ""
                elif name in ("dd", "blockquote"):
                    self.indent.pop()

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def table_lines(table: Element, depth: int) -> list[str]:
    """Rows of a table with their cells in columns; a caption and stray text come first."""
    before, rows = Page(depth), []
    todo = [(c, None) for c in reversed(table.children)]
    while todo:
        node, row = todo.pop()
        if isinstance(node, str):
            before.write(node)
        elif not node.shown:
            continue
        elif node.name in ("thead", "tbody", "tfoot"):
            todo.extend((c, None) for c in reversed(node.children))
        elif node.name == "tr":
            rows.append([])
            todo.extend((c, rows[-1]) for c in reversed(node.children))
        elif node.name in ("td", "th"):
            if row is None:
                rows.append(row := [])
            cell = Page(depth)
            for child in node.children:
                cell.render(child) if isinstance(child, Element) else cell.write(child)
            row.append(cell.done() or [""])
            span = node.attributes.get("colspan", "1")
            row.extend([[""]] * (min(int(span), 1000) - 1 if re.fullmatch(r"\d{1,9}", span) and int(span) else 0))
        else:
            before.render(node)
            before.end_line()
    widths: list[int] = []
    for row in rows:
        widths += [0] * (len(row) - len(widths))
        for i, cell in enumerate(row):
            widths[i] = max(widths[i], *map(len, cell))
    out = before.done()
    for row in rows:
        for k in range(max(map(len, row), default=0)):
            parts = [(cell[k] if k < len(cell) else "").ljust(widths[i]) for i, cell in enumerate(row)]
            out.append("  ".join(p for p, w in zip(parts, widths) if w).rstrip())
    return out


def page_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page()
    page.render(parse(source.replace("\r\n", "\n").replace("\0", "")))
    return "\n".join(page.done())


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col`` and text of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([page_text(x.as_py()) for x in some.column(1)], pa.string())], [id_col, "text"])

    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, text string")
