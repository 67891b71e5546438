"""Metadata from document headers, file titles and questions, as ``Column`` expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import rules
from corpusloom.functions.text import Cols, _c, compose_accents, null_if_blank, py_strip


def _first(text: Cols, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(_c(text), F.lit("")), pattern, group), F.lit(""))


def strip_markdown(text: Cols) -> Column:
    """Drop heading hashes at line starts and bold markers."""
    plain = F.regexp_replace(_c(text), r"(?mU)^\s{0,3}#{1,6}\s+", "")
    return F.replace(F.replace(plain, F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))


def doc_type(
    header: Cols,
    type_rules: Sequence[tuple[str, str]] = rules.DOC_TYPE_RULES,
    other: str | None = rules.DOC_TYPE_OTHER,
) -> Column:
    """Label of the first rule (in rule order) whose pattern occurs anywhere in the header."""
    hits = [F.when(F.rlike(_c(header), F.lit(p)), F.lit(label)) for label, p in type_rules]
    return F.coalesce(*hits, F.lit(other))


def issued_date(header: Cols, pattern: str = rules.DATE_PATTERN) -> Column:
    """The "day D month M year Y" phrase as dd/mm/yyyy text; null without a match."""
    day, month, year = (_first(header, pattern, g) for g in (1, 2, 3))
    return F.when(
        day.isNotNull(), F.concat_ws("/", F.lpad(day, 2, "0"), F.lpad(month, 2, "0"), year)
    )


def issuing_body(header: Cols, prefixes: Sequence[str] = rules.ISSUER_PREFIXES) -> Column:
    """First line that starts with one of the prefixes, trimmed."""
    choice = "|".join(re.escape(p) for p in prefixes)
    return null_if_blank(_first(header, rf"(?imu)^((?:{choice})[^\n]*)", 1))


def doc_number(
    header: Cols, pattern: str = rules.NUMBER_PATTERN, label: str = rules.NUMBER_LABEL
) -> Column:
    """Document number with its label, null when the header has none."""
    return F.concat(F.lit(label), _first(header, pattern, 1))


def parse_year(text: Cols) -> Column:
    """First pair of years as YYYY-YYYY."""
    pattern = "(?U)" + rules.YEAR_PATTERN
    start = _first(text, pattern, 1)
    return F.when(start.isNotNull(), F.concat(start, F.lit("-"), _first(text, pattern, 2)))


def locality_name(text: Cols, pattern: str = rules.LOCALITY_PATTERN) -> Column:
    """The name after a locality keyword, composed and with single spaces, not yet canonical."""
    name = F.regexp_replace(compose_accents(_first(text, pattern, 1)), r"(?U)\s+", " ")
    return null_if_blank(name)


def file_stem(name: Cols) -> Column:
    """File name without folders and without its last extension."""
    base = F.regexp_extract(F.coalesce(_c(name), F.lit("")), r"([^/]*)/*$", 1)
    return F.coalesce(_first(base, r"(?s)^(.+)\.[^.]+$", 1), base)


def file_extension(name: Cols) -> Column:
    """Lower-case last extension without the dot, "" if there is none."""
    base = F.regexp_extract(F.coalesce(_c(name), F.lit("")), r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(base, r"(?s)^.+\.([^.]+)$", 1))


def lookup_key(name: Cols) -> Column:
    return F.lower(py_strip(name))


def upload_check(
    filename: Cols,
    mime_type: Cols,
    size: Cols,
    allowed: dict[str, str] | None = None,
    max_mb: int = rules.MAX_UPLOAD_MB,
) -> Column:
    """Struct(extension, media_type, problem) for an uploaded file; ``problem`` is null when accepted."""
    allowed = allowed or rules.UPLOAD_TYPES
    ext = file_extension(filename)
    from_name = F.when(ext.isin(*allowed), ext)
    from_mime = F.coalesce(*[F.when(_c(mime_type) == m, F.lit(e)) for e, m in allowed.items()])
    known = F.coalesce(from_name, from_mime)
    media = F.coalesce(*[F.when(known == e, F.lit(m)) for e, m in allowed.items()])
    return F.struct(
        known.alias("extension"),
        F.coalesce(media, F.lit(rules.DEFAULT_MEDIA_TYPE)).alias("media_type"),
        F.when(known.isNull(), "unsupported")
        .when(_c(size) == 0, "empty")
        .when(_c(size) > max_mb * 1024 * 1024, "too large")
        .alias("problem"),
    )
