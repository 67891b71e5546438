"""Quality rules: distance of a document's histograms from those of its language.

Two histograms are taken of each document: code points by class, and words by a short list of common
words of the language (all other words are one more bin).  The references are the sums of these
histograms over all documents of the language (``language_references``, the default, as the SQL of the query has
them), or medians over the distinct texts that pass the base rules (``robust_references``, to be passed: no
group of copies and no long document moves them).  A document is judged by the Jensen-Shannon distance
(root of the divergence to base 2, between 0 and 1) of each histogram from its reference.

Defined cases: a null or empty text has zero counts and fails the base rules.  A null or unlisted
language is judged by code points only, against all documents without a listed language.  Histograms
below the minimum lengths, and references with too little text, do not judge.  Repeated rows are judged
one by one; other columns are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common words by language.
COMMON_WORDS = {
    "de": "der die das und in zu den mit von für ist nicht ein eine auf dem sich im auch es an als wie".split(),
    "en": "the of and to in is that for it with as was on are by this at from or be an have not which".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo como más o".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus ne ce il".split(),
}
OTHER = "und"
#: Classes of code points: a-z, A-Z, 0-9, white space, symbols, other printable ASCII, other ASCII, and
#: those of two, three and four UTF-8 bytes.  Bytes that continue a code point are class 10.
CLASSES = 10
SYMBOLS = "#*$%&|<>"

#: A document is rejected beyond these distances, if its histograms reach these lengths.
MAX_CLASS_DISTANCE = 0.33
MAX_WORD_DISTANCE = 0.34
MIN_CODE_POINTS = 200
MIN_WORDS = 100
#: Code points below which the documents of a language make no reference.
MIN_REFERENCE = 20_000
#: Texts that a task remembers to pass over their copies.
SEEN_TEXTS = 500_000


def byte_classes() -> np.ndarray:
    table = np.full(256, 6, np.uint8)
    table[0x21:0x7F] = 5
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[[0x20, *range(0x09, 0x0E)]] = 3
    table[[ord(x) for x in SYMBOLS]] = 4
    table[0x80:0xC0] = 10
    table[0xC0:0xE0] = 7
    table[0xE0:0xF0] = 8
    table[0xF0:] = 9
    return table


CLASS_OF_BYTE = byte_classes()
#: For the words of the histogram: A-Z lower-cased, ASCII punctuation taken as white space.
PLAIN = bytes(
    x + 32 if 65 <= x <= 90 else 32 if 33 <= x <= 47 or 58 <= x <= 64 or 91 <= x <= 96 or 123 <= x <= 126 else x
    for x in range(256)
)


def language_key(lang: str | None) -> str:
    return lang if lang in COMMON_WORDS else OTHER


def class_counts(raw: bytes) -> np.ndarray:
    return np.bincount(CLASS_OF_BYTE[np.frombuffer(raw, np.uint8)], minlength=CLASSES + 1)[:CLASSES]


def word_counts(raw: bytes, key: str) -> np.ndarray:
    """Counts of the language's common words, and last of all others; empty without a list."""
    common = COMMON_WORDS.get(key)
    if common is None:
        return np.zeros(0, np.int64)
    words = raw.translate(PLAIN).split()
    found = Counter(words)
    counts = [found.get(w.encode(), 0) for w in common]
    return np.array([*counts, len(words) - sum(counts)], np.int64)


def distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms that both have a sum above zero."""
    p, q = counts / counts.sum(), reference / reference.sum()
    m = (p + q) / 2
    part = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if found[w] > 1:
            covered[i] = covered[i + 1] = covered[i + 2] = 1
    return covered.count(1)


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def judge(text: str | None, lang: str | None, references: dict[tuple[str, str], np.ndarray], limits: dict) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class and word distance, kept)."""
    raw, key = (text or "").encode(), language_key(lang)
    words, classes = raw.split(), class_counts(raw)
    n, repeats, points = len(words), repeat_words(words), int(classes.sum())
    failed = n < 50 or 100 * repeats > 50 * n
    by_class = by_word = None
    wanted = references.get((key, "class"))
    if wanted is not None and wanted.sum() >= limits["min_reference"] and points >= limits["min_code_points"]:
        by_class = distance(classes, wanted)
        wanted, counts = references.get((key, "word")), word_counts(raw, key)
        if wanted is not None and counts.sum() >= limits["min_words"] and wanted.sum() > 0:
            by_word = distance(counts, wanted)
    kept = not failed and (by_class is None or by_class <= limits["max_class_distance"]) and (by_word is None or by_word <= limits["max_word_distance"])
    return n, points - int(classes[3]), int(classes[4]), repeated_lines(raw), repeats, failed, by_class, by_word, kept


def language_references(docs: DataFrame) -> DataFrame:
    """Histograms summed over all documents of a language: lang_key, kind (class or word), bin, count.

    Each task adds up its own documents, so that a language with most rows costs no shuffle.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                raw, key = (text or "").encode(), language_key(lang)
                for kind, counts in (("class", class_counts(raw)), ("word", word_counts(raw, key))):
                    sums[key, kind] = sums.get((key, kind), 0) + counts
        rows = [(key, kind, i, int(x)) for (key, kind), counts in sums.items() for i, x in enumerate(counts)]
        columns = zip(*rows) if rows else ((), (), (), ())
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["lang_key", "kind", "bin", "count"])

    part = docs.select("text", "lang").mapInArrow(add_up, "lang_key string, kind string, bin int, count long")
    return part.groupBy("lang_key", "kind", "bin").agg(F.sum("count").alias("count"))


def robust_references(docs: DataFrame, **changed: float) -> DataFrame:
    """References that copies, long texts and a minority of junk do not move; columns as ``language_references``.

    Of each distinct text of a language that passes the base rules, the shares of the bins count once.  Each bin
    is their median, times the code points of these texts.  Copies leave a task once, so that a group of them is
    at most one row for each task.
    """
    bounds = limits(**changed)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            rows = []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                raw, key = (text or "").encode(), language_key(lang)
                name = (key, xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                if name in seen or not raw:
                    continue
                if len(seen) < SEEN_TEXTS:
                    seen.add(name)
                words, classes = raw.split(), class_counts(raw)
                points = int(classes.sum())
                if points < bounds["min_code_points"] or len(words) < 50 or 100 * repeat_words(words) > 50 * len(words):
                    continue
                common = word_counts(raw, key)
                enough = len(common) and common.sum() >= bounds["min_words"]
                bins = [*(classes / points).tolist(), *((common / common.sum()).tolist() if enough else [])]
                rows.append((*name, points, bins))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float32()))
            columns = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["lang_key", "hash", "points", "shares"])

    each = docs.select("text", "lang").mapInArrow(shares, "lang_key string, hash long, points long, shares array<float>")
    bins = each.dropDuplicates(["lang_key", "hash"]).select("lang_key", "points", F.posexplode("shares").alias("bin", "share"))
    middle = bins.groupBy("lang_key", "bin").agg(F.percentile_approx("share", 0.5).alias("share"), F.sum("points").alias("points"))
    is_class = F.col("bin") < CLASSES
    return middle.select(
        "lang_key",
        F.when(is_class, "class").otherwise("word").alias("kind"),
        F.when(is_class, F.col("bin")).otherwise(F.col("bin") - CLASSES).alias("bin"),
        F.round(F.col("share") * F.col("points")).cast("long").alias("count"),
    )


def reference_arrays(references: DataFrame) -> dict[tuple[str, str], np.ndarray]:
    """The references as arrays: at most 35 numbers for each listed language."""
    out: dict[tuple[str, str], np.ndarray] = {}
    for key, kind, i, count in references.collect():
        size = CLASSES if kind == "class" else len(COMMON_WORDS[key]) + 1
        out.setdefault((key, kind), np.zeros(size, np.int64))[i] = count
    return out


def limits(**changed: float) -> dict:
    return {
        "max_class_distance": MAX_CLASS_DISTANCE,
        "max_word_distance": MAX_WORD_DISTANCE,
        "min_code_points": MIN_CODE_POINTS,
        "min_words": MIN_WORDS,
        "min_reference": MIN_REFERENCE,
    } | changed


RESULT = (
    ("n_words", "long", pa.int64()),
    ("word_chars", "long", pa.int64()),
    ("n_symbols", "long", pa.int64()),
    ("n_dup_lines", "long", pa.int64()),
    ("n_repeat_words", "long", pa.int64()),
    ("base_failed", "boolean", pa.bool_()),
    ("class_distance", "double", pa.float64()),
    ("word_distance", "double", pa.float64()),
    ("kept", "boolean", pa.bool_()),
)


def quality_rules(docs: DataFrame, references: DataFrame | None = None, **changed: float) -> DataFrame:
    """Counts, distances and verdict of each document: doc_id and the columns of ``RESULT``.

    ``references`` as ``language_references`` gives them; by default those of ``docs`` itself.
    Each document is judged where it is read: no shuffle.
    """
    known, bounds = reference_arrays(language_references(docs) if references is None else references), limits(**changed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t, x, known, bounds) for t, x in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist())]
            found = [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(RESULT)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found], ["doc_id", *(x[0] for x in RESULT)])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "lang").mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{a} {b}" for a, b, _ in RESULT))


def keep_good(docs: DataFrame, references: DataFrame | None = None, **changed: float) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    known, bounds = reference_arrays(language_references(docs) if references is None else references), limits(**changed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [judge(t, x, known, bounds)[-1] for t, x in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist())]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
