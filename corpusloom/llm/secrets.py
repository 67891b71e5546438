"""Secret scan: patterns of known secrets, and sliding-window Shannon entropy over candidate strings.

Known kinds are found by pattern, leftmost and without overlaps per kind, and those too short are dropped.
For the rest, runs of token characters are candidates where they hold a digit and a letter.  A candidate's
character class (hexadecimal, one case, both cases, with symbols) sets the entropy in bits that a window of ``WIDTH``
characters must reach.  The window slides by one character: the numbers of the arriving and of the leaving
character are counted in the part both windows share, and the sum of c log2 c moves by their differences.
A candidate with one window at or over its class's limit is a span of kind ``entropy``.  The allow-list
suppresses candidates that look random and are no secrets: identifiers of the UUID form, checksums with
their algorithm's name, counted-up alphabets, placeholders, paths.  What the patterns found always stays,
and a candidate that is nothing but one of their strings is not reported twice.

Defined cases: a null or empty text has no spans.  Each row gives one row, also repeated ones; other columns
are not looked at.  Offsets are code points, ends exclusive.  Texts and candidates of any length are read
whole, in time proportional to their length.  Everything is done in the row, without Python: no shuffle.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import matches
from corpusloom.functions.text import let

# Kinds in order, each with its pattern.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
#: Every assignment holds this, which is found faster than the whole.
ASSIGN_SIGN = r"""[DTNYdtny]["']?\x20*[:=]"""
#: Least lengths: of the value of an assignment, of an access key, of a hexadecimal string.
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: Characters in a window, and the least length of a candidate.
WIDTH = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: The same, without trying again inside a run that is too short.
WHOLE_RUN = r"(?<![A-Za-z0-9+/_-])" + CANDIDATE
#: Character classes in order, with the bits a window must reach.  At 20 characters the most is 4.32; random
#: hexadecimal digits give about 3.3, random letters and digits of one case 3.8, of both cases 4.1.
CLASSES = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 2.95),
    ("one case", r"^(?:[0-9a-z]+|[0-9A-Z]+)$", 3.55),
    ("both cases", r"^[0-9A-Za-z]+$", 3.65),
    ("symbols", r"", 3.85),
)
#: Candidates that are no secrets.
ALLOWED = (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"^(?:md5|sha1|sha224|sha256|sha384|sha512)[-_]",
    r"(?i)0123456789|1234567890|abcdefghij|example|sample|placeholder|xxxxx|changeme|your[-_]",
    r"^[a-z]*(?:[/_-][a-z]+|[/_-][0-9]{1,4})+$",
)


def window_entropy(text: Column, width: int = WIDTH) -> Column:
    """The highest Shannon entropy, in bits, of any ``width`` neighbouring characters; 0 for shorter texts."""
    weights = F.array(*(F.lit(float(c * log2(c)) if c else 0.0) for c in range(width + 2)))

    def gain(count: Column) -> Column:
        return F.element_at(weights, count + 2) - F.element_at(weights, count + 1)

    def count(ch: Column, window: Column) -> Column:
        return F.char_length(window) - F.char_length(F.replace(window, ch, F.lit("")))

    def state(window: Column, total: Column, best: Column) -> Column:
        return F.struct(window.alias("window"), total.alias("total"), best.alias("best"))

    def leave(acc: Column) -> Column:
        rest, out = F.substring(acc["window"], 2, width), F.substring(acc["window"], 1, 1)
        return F.when(F.char_length(acc["window"]) == width, state(rest, acc["total"] - gain(count(out, rest)), acc["best"])).otherwise(acc)

    def arrive(acc: Column, ch: Column) -> Column:
        total = acc["total"] + gain(count(ch, acc["window"]))
        bits = F.when(F.char_length(acc["window"]) == width - 1, F.lit(log2(width)) - total / width).otherwise(F.lit(0.0))
        return state(F.concat(acc["window"], ch), total, F.greatest(acc["best"], bits))

    start = state(F.lit(""), F.lit(0.0), F.lit(0.0))
    return F.aggregate(F.split(text, "(?!^)(?!$)", -1), start, lambda acc, ch: let(leave(acc), lambda left: arrive(left, ch)))["best"]


def class_of(text: Column) -> Column:
    """Name of the first character class that a candidate belongs to."""
    found = F.when(F.lit(False), F.lit(""))
    for name, pattern, _ in CLASSES[:-1]:
        found = found.when(text.rlike(pattern), F.lit(name))
    return found.otherwise(F.lit(CLASSES[-1][0]))


def limit_of(text: Column) -> Column:
    return F.create_map(*(F.lit(x) for name, _, bits in CLASSES for x in (name, bits)))[class_of(text)]


def is_random(text: Column) -> Column:
    """Whether a candidate reaches its class's entropy and the allow-list does not know it."""
    mixed = text.rlike("[0-9]") & text.rlike("[A-Za-z]")
    known = text.rlike("^[0-9a-f]{%d,}$|^AKIA[A-Z0-9]{%d,}$" % (MIN_HEX, MIN_ACCESS - 4))
    allowed = text.rlike("|".join(f"(?:{p})" for p in ALLOWED))
    return F.when(mixed & ~known & ~allowed, window_entropy(text) >= limit_of(text)).otherwise(F.lit(False))


def secret_spans(text: Column) -> Column:
    """All spans of a text by start, then kind in the order of KINDS: start, place (of the kind), kind, end, text."""

    def of(place: int, found: Column) -> Column:
        return F.transform(
            found,
            lambda m: F.struct(m["start"].alias("start"), F.lit(place).alias("place"), F.lit(KINDS[place]).alias("kind"), m["end"].alias("end"), m["text"].alias("text")),
        )

    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")

    def kinds(whole: Column) -> Column:
        assigned = F.when(whole.rlike(ASSIGN_SIGN), matches(whole, ASSIGN)).otherwise(none)
        assigned = F.filter(assigned, lambda m: F.char_length(F.regexp_extract(m["text"], ASSIGN, 1)) >= MIN_VALUE)
        access = matches(whole, ACCESS.replace("+", "{%d,}" % (MIN_ACCESS - 4)))
        digits = matches(whole, HEX.replace("+", "{%d,}" % MIN_HEX))
        random = F.filter(matches(whole, WHOLE_RUN), lambda m: is_random(m["text"]))
        return F.array_sort(F.concat(of(0, assigned), of(1, access), of(2, digits), of(3, random)))

    return let(F.coalesce(text, F.lit("")), kinds)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of each row's text: start, place, kind, end, text."""
    return docs.select("doc_id", secret_spans(F.col("text")).alias("spans"))
