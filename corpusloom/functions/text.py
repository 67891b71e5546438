"""Text functions on columns; rows with letters that the JVM has no function for go through Arrow."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Task code travels with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Cols = Column | str


def _c(value: Cols) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Needed wherever a computed value is used inside an array lambda: there it would otherwise be
    evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def unnest(df: DataFrame, keep: Sequence[Cols], array: Cols, pos: str, value: str) -> DataFrame:
    """One row per array element with its 0-based position.

    The outer form is used on purpose: for the inner one Spark adds filters on the array's size below
    the explode, which evaluates a computed array several times.
    """
    rows = df.select(*keep, F.posexplode_outer(_c(array)).alias(pos, value))
    return rows.filter(F.col(pos).isNotNull())


#: The characters of Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def py_strip(text: Cols) -> Column:
    """Trim all leading and trailing whitespace, not only spaces."""
    return F.btrim(_c(text), F.lit(WHITE_SPACE))


def is_blank(text: Cols) -> Column:
    """True for null and for strings without a non-whitespace character."""
    return ~F.coalesce(F.rlike(_c(text), F.lit(r"(?U)\S")), F.lit(False))


def null_if_blank(text: Cols) -> Column:
    return F.when(~is_blank(text), py_strip(text))


def count_tokens(text: Cols) -> Column:
    """Whitespace-separated words; 0 for null or blank."""
    return F.coalesce(F.regexp_count(_c(text), F.lit(r"(?U)\S+")), F.lit(0))


@cache
def _accent_table() -> tuple[str, str]:
    return _letters_with_marks()


def _letters_with_marks() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base letter plus marks, and those letters.

    Derived from the Unicode data base; đ/Đ has no decomposition and is added by hand.
    """
    source, target = ["đ", "Đ"], ["d", "D"]
    for code in range(0xC0, 0x1F00):
        char = chr(code)
        bare = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != char:
            source.append(char)
            target.append(bare)
    return "".join(source), "".join(target)


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def _without_marks(text: str) -> str:
    parts = unicodedata.normalize("NFD", unicodedata.normalize("NFC", text).replace("đ", "d").replace("Đ", "D"))
    return "".join(c for c in parts if not unicodedata.combining(c)).lower()


@F.pandas_udf(StringType())
def _bare(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None else _without_marks(x))


_ODD = re.compile("[^\x00-\u024F\u1E00-\u1EFF\u2000-\u206F\u20A0-\u20CF]")
_BASE_LETTERS: dict[int, str] = {}


def normalized(text: str | None) -> str:
    """``normalize_text`` for task code that holds the text already."""
    if not text:
        return ""
    if text.isascii():
        bare = text.lower()
    elif _ODD.search(text):
        bare = _without_marks(text)
    else:
        if not _BASE_LETTERS:
            _BASE_LETTERS.update(str.maketrans(*_letters_with_marks()))
        bare = text.translate(_BASE_LETTERS).lower()
    return " ".join(bare.split())


def compose_accents(text: Cols) -> Column:
    """Canonical composition; text without combining marks is untouched and stays in the JVM."""
    raw = _c(text)
    marked = F.rlike(raw, F.lit(r"\p{M}"))
    return F.when(marked, _composed(F.when(marked, raw))).otherwise(raw)


#: Characters whose accents a table can take off: Latin letters, punctuation and currency signs.
_LATIN = r"\A[\x00-\u024F\u1E00-\u1EFF\u2000-\u206F\u20A0-\u20CF]*\z"


def normalize_text(text: Cols) -> Column:
    """Accent-free, lower case, single spaces, trimmed; null becomes "".

    Marks of a combining class are dropped after canonical decomposition.  Pure ASCII rows skip that, Latin
    rows take a table in the JVM, and only rows with other letters or loose marks go through Arrow.
    """
    raw = _c(text)
    source, target = _accent_table()
    plain, latin = F.octet_length(raw) == F.char_length(raw), F.rlike(raw, F.lit(_LATIN))
    bare = F.when(plain, F.lower(raw)).when(latin, F.lower(F.translate(raw, source, target))).otherwise(_bare(F.when(~latin, raw)))
    return F.coalesce(F.trim(F.regexp_replace(bare, r"(?U)[\s\x1C-\x1F]+", " ")), F.lit(""))


def words(text: Cols) -> Column:
    """Words of the normalized text."""
    return F.filter(F.split(normalize_text(text), " "), lambda w: w != "")


def shingles(word_array: Column, n: int = 3) -> Column:
    """Distinct n-word shingles as strings; a shorter text gives one shingle of all its words."""

    def body(ws: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(1)))
        windows = F.transform(starts, lambda i: F.array_join(F.slice(ws, i, n), " "))
        return F.when(F.size(ws) > 0, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))

    return let(word_array, body)


def word_trigrams(text: Cols) -> Column:
    return shingles(words(text), 3)


def trigram_recall(reference: Cols, chunk: Cols) -> Column:
    """Share of the reference's trigrams found in the chunk, for a pair already on one row."""
    pair = F.struct(word_trigrams(reference).alias("wanted"), word_trigrams(chunk).alias("held"))
    return let(
        pair,
        lambda p: F.when(
            F.size(p["wanted"]) > 0, F.size(F.array_intersect(p["wanted"], p["held"])) / F.size(p["wanted"])
        ).otherwise(F.lit(0.0)),
    )


def search_terms(text: Cols) -> Column:
    """Lower-cased runs of letters and digits, in text order."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def regex_literal(text: Cols) -> Column:
    """The text quoted for use inside a Java pattern."""
    safe = F.replace(_c(text), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), safe, F.lit("\\E"))


def keyword_present(keyword: Cols, text: Cols) -> Column:
    """Normalized keyword inside normalized text, not glued to another ASCII letter or digit."""
    kw, body = _c(keyword), _c(text)
    pattern = F.concat(F.lit("(?<![a-z0-9])"), regex_literal(kw), F.lit("(?![a-z0-9])"))
    return F.coalesce((kw != "") & F.contains(body, kw) & F.rlike(body, pattern), F.lit(False))


def is_specific(keyword: Cols) -> Column:
    """Specific without corpus statistics: three characters, or a letter, or a separator."""
    kw = _c(keyword)
    return (F.char_length(kw) >= 3) | F.rlike(kw, F.lit("[a-z]")) | F.rlike(kw, F.lit("[^a-z0-9]"))


def chunk_type(text: Cols) -> Column:
    """``list`` when at least two lines start with a dash or star bullet, else ``text``."""
    bullets = F.regexp_count(_c(text), F.lit(r"(?U)(?:^|(?<=\n))[^\S\n]*[-*] "))
    return F.when(bullets >= 2, "list").otherwise("text")


def heading_context(
    path: Column, doc_name: Cols, filename: Cols, extra: Cols | None = None, wording: dict | None = None
) -> Column:
    """One sentence naming the document and the heading path; absent parts are left out."""
    from corpusloom.rules import CONTEXT_WORDING

    w = wording or CONTEXT_WORDING
    name = F.coalesce(F.nullif(_c(doc_name), F.lit("")), F.nullif(_c(filename), F.lit("")))
    parts = [
        F.concat(F.lit(w["document"]), name, F.lit(".")),
        F.when(
            F.coalesce(F.size(path), F.lit(0)) > 0,
            F.concat(F.lit(w["under"]), F.array_join(path, " > "), F.lit(".")),
        ),
    ]
    if extra is not None:
        parts.append(F.nullif(extra if isinstance(extra, Column) else F.lit(extra), F.lit("")))
    return py_strip(F.concat_ws(" ", *parts))


def contextual_text(context: Cols, content: Cols) -> Column:
    """Context, blank line, content; content alone when there is no context."""
    ctx = F.nullif(_c(context), F.lit(""))
    return F.when(ctx.isNull(), _c(content)).otherwise(F.concat(ctx, F.lit("\n\n"), _c(content)))


def clean_path(path: Column) -> Column:
    """Trim entries, drop blank ones, null when nothing is left."""
    kept = F.filter(F.transform(path, py_strip), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, kept)


def uuid_v5(namespace_hex: str, name: Cols) -> Column:
    """Name-based UUID (version 5) computed in the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex.replace("-", ""))), F.encode(_c(name), "UTF-8")))
    variant_digit = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(variant_digit.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def document_uuid(document_id: Cols) -> Column:
    """Stable reference id of a document."""
    from corpusloom.rules import DOCUMENT_ID_PREFIX, URL_NAMESPACE

    return uuid_v5(URL_NAMESPACE, F.concat(F.lit(DOCUMENT_ID_PREFIX), _c(document_id).cast("string")))


def chunk_uuid(document_id: Cols, chunk_index: Cols) -> Column:
    """Stable id of a chunk, so that a retried write replaces rather than duplicates."""
    from corpusloom.rules import DOCUMENT_ID_PREFIX, URL_NAMESPACE

    name = F.concat(
        F.lit(DOCUMENT_ID_PREFIX), _c(document_id).cast("string"), F.lit("/"), _c(chunk_index).cast("string")
    )
    return uuid_v5(URL_NAMESPACE, name)


def rounded(value: Column, digits: int = 6) -> Column:
    """Scores are rounded before they are compared, so that ranking does not depend on summation order."""
    return F.round(value, digits)
