"""Citation checking of answers, and highlighting of quotes.

An answer, its sources and its verdicts are one row, so checking is row-local.  Only tables that can
grow without bound per key (ranges) use sectioned windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import rules
from corpusloom.functions import citations as C
from corpusloom.functions.text import let, py_strip, regex_literal, unnest

VERDICT = "struct<sentence_id:int,attributed:array<int>,quote:string,supported:boolean,in_scope:boolean,action:string>"
REQUIRED = ("sentence_id", "attributed_indices", "supporting_quote", "supported", "in_scope", "action")
RANGE = "struct<start:int,end:int>"
EMPTY_INTS = "array<int>"


# --- verdicts ------------------------------------------------------------------------------------


def parse_verdicts(answers: DataFrame, column: str = "verdict_json") -> DataFrame:
    """Add ``verdicts`` and ``verdict_error``.

    The reply may be fenced or surrounded by prose.  Without a ``verdicts`` list the run failed; a
    verdict with a missing field is skipped.
    """
    doc = F.try_parse_json(C.outermost_json(column))
    listed = F.try_variant_get(doc, "$.verdicts", "array<variant>")

    def complete(v: Column) -> Column:
        present = [F.try_variant_get(v, f"$.{f}", "variant").isNotNull() for f in REQUIRED]
        out = present[0]
        for p in present[1:]:
            out = out & p
        return out

    def one(v: Column) -> Column:
        return F.struct(
            F.try_variant_get(v, "$.sentence_id", "int").alias("sentence_id"),
            F.try_variant_get(v, "$.attributed_indices", "array<int>").alias("attributed"),
            F.coalesce(F.try_variant_get(v, "$.supporting_quote", "string"), F.lit("")).alias("quote"),
            F.coalesce(F.try_variant_get(v, "$.supported", "boolean"), F.lit(False)).alias("supported"),
            F.coalesce(F.try_variant_get(v, "$.in_scope", "boolean"), F.lit(False)).alias("in_scope"),
            F.try_variant_get(v, "$.action", "string").alias("action"),
        ).cast(VERDICT)

    parsed = answers.withColumn("verdicts", F.transform(F.filter(listed, complete), one))
    broken = F.exists("verdicts", lambda v: v["sentence_id"].isNull() | v["attributed"].isNull())
    return parsed.withColumn("verdict_error", F.col("verdicts").isNull() | F.coalesce(broken, F.lit(False)))


def verdict_rows(parsed: DataFrame, key: str = "answer_id") -> DataFrame:
    """Usable verdicts as rows: known sentences only, the last duplicate wins."""
    ids = F.transform(C.split_sentences("answer"), lambda s: s["id"])
    known = unnest(parsed.filter(~F.col("verdict_error")), [key, ids.alias("_ids")], "verdicts", "_pos", "v")
    known = known.filter(F.array_contains("_ids", F.col("v.sentence_id")))
    last = known.groupBy(key, F.col("v.sentence_id").alias("sentence_id")).agg(F.max_by("v", "_pos").alias("v"))
    return last.select(
        key,
        "sentence_id",
        F.col("v.attributed").alias("attributed"),
        F.col("v.quote").alias("quote"),
        F.col("v.supported").alias("supported"),
        F.col("v.in_scope").alias("in_scope"),
        F.col("v.action").alias("action"),
    )


JUDGED = "struct<id:int,text:string,delim:string,kept:boolean,indices:array<int>,quote:string>"


def judged_sentences(answer: Column, verdicts: Column, valid: Column) -> Column:
    """Sentences after their verdicts: kept or not, corrected text, confirmed source indices, quote."""
    inside = lambda xs, allowed: F.filter(xs, lambda i: F.array_contains(allowed, i))

    def one(s: Column, allowed: Column, vs: Column) -> Column:
        mine = F.filter(vs, lambda v: v["sentence_id"] == s["id"])

        def build(v: Column) -> Column:
            own = inside(s["cited"], allowed)
            confirmed = F.coalesce(inside(v["attributed"], allowed), F.array().cast(EMPTY_INTS))
            indices = F.when(F.size(confirmed) > 0, confirmed).otherwise(own)
            fix = (F.coalesce(v["action"], F.lit("")) == "recite") & (F.size(indices) > 0)
            return F.struct(
                s["id"].alias("id"),
                F.when(fix, C.recite(s["text"], indices)).otherwise(s["text"]).alias("text"),
                s["delim"].alias("delim"),
                (F.coalesce(v["action"], F.lit("")) != "drop").alias("kept"),
                indices.alias("indices"),
                F.coalesce(py_strip(v["quote"]), F.lit("")).alias("quote"),
            ).cast(JUDGED)

        return let(F.get(mine, F.size(mine) - 1), build)

    empty = F.array().cast(f"array<{VERDICT}>")
    return let(
        F.struct(F.coalesce(valid, F.array().cast(EMPTY_INTS)).alias("ok"), F.coalesce(verdicts, empty).alias("vs")),
        lambda e: F.transform(C.split_sentences(answer), lambda s: one(s, e["ok"], e["vs"])),
    )


def apply_verdicts(parsed: DataFrame) -> DataFrame:
    """Add ``judged`` (sentences), ``new_answer`` and ``dropped_count``.

    ``parsed(answer, sources array<struct<index,...>>, verdicts)``.
    """
    valid = F.transform("sources", lambda s: s["index"])
    out = parsed.withColumn("judged", judged_sentences(F.col("answer"), F.col("verdicts"), valid))
    kept = F.filter("judged", lambda s: s["kept"])
    return out.withColumn(
        "new_answer", py_strip(F.array_join(F.transform(kept, lambda s: F.concat(s["text"], s["delim"])), ""))
    ).withColumn("dropped_count", F.size("judged") - F.size(kept))


def cited_sets(applied: DataFrame) -> DataFrame:
    """Add ``cited_indices`` (sorted) and ``cited_spans``: per index its distinct quotes, first seen first."""
    kept = F.filter("judged", lambda s: s["kept"])
    cited = F.array_sort(F.array_distinct(F.flatten(F.transform(kept, lambda s: s["indices"]))))

    def spans(ks: Column) -> Column:
        return F.transform(
            F.col("cited_indices"),
            lambda i: F.struct(
                i.alias("index"),
                F.array_distinct(
                    F.transform(
                        F.filter(ks, lambda s: F.array_contains(s["indices"], i) & (s["quote"] != "")),
                        lambda s: s["quote"],
                    )
                ).alias("quotes"),
            ),
        )

    return applied.withColumn("cited_indices", cited).withColumn("cited_spans", let(kept, spans))


def verification_failsafe(cited: DataFrame) -> DataFrame:
    """Final answer, cited indices, spans, ``ok``: a failed or all-dropping run keeps the original."""
    nothing = F.size("judged") == 0
    failed = ~nothing & (F.col("verdict_error") | (F.col("new_answer") == ""))
    keep_all = nothing | failed
    valid = F.array_sort(F.array_distinct(F.transform("sources", lambda s: s["index"])))
    spans = F.array().cast("array<struct<index:int,quotes:array<string>>>")
    return (
        cited.withColumn("_all", keep_all)
        .withColumn("ok", ~failed)
        .withColumn("final_answer", F.when(F.col("_all"), F.col("answer")).otherwise(F.col("new_answer")))
        .withColumn("cited_indices", F.when(F.col("_all"), valid).otherwise(F.col("cited_indices")))
        .withColumn("cited_spans", F.when(F.col("_all"), spans).otherwise(F.col("cited_spans")))
        .withColumn("dropped_count", F.when(F.col("_all"), 0).otherwise(F.col("dropped_count")))
        .drop("_all")
    )


def filter_sources(checked: DataFrame) -> DataFrame:
    """Keep cited sources and attach their quotes ([] without any); unchanged when the check failed."""
    fields = [f.name for f in checked.schema["sources"].dataType.elementType.fields]

    def with_spans(s: Column, spans: Column) -> Column:
        return F.struct(*[s[f].alias(f) for f in fields], spans.alias("cited_spans"))

    none = F.lit(None).cast("array<string>")
    quotes_of = lambda found, i: F.coalesce(
        F.get(F.filter(found, lambda c: c["index"] == i), F.lit(0))["quotes"], F.array().cast("array<string>")
    )

    def keep(e: Column) -> Column:
        chosen = F.filter("sources", lambda s: F.array_contains(e["cited"], s["index"]))
        return F.transform(chosen, lambda s: with_spans(s, quotes_of(e["spans"], s["index"])))

    found = F.struct(F.col("cited_indices").alias("cited"), F.col("cited_spans").alias("spans"))
    return checked.withColumn(
        "sources",
        F.when(F.col("ok"), let(found, keep)).otherwise(F.transform("sources", lambda s: with_spans(s, none))),
    )


def revision_decision(checked: DataFrame, revision: Column, max_revisions: int = 1) -> DataFrame:
    """Add ``revise``: the check worked, something was dropped, and revisions are left."""
    return checked.withColumn("revise", F.col("ok") & (F.col("dropped_count") > 0) & (revision < max_revisions))


def verify_answers(answers: DataFrame) -> DataFrame:
    """Verdict JSON to final answers and sources in one row-local pass."""
    return filter_sources(verification_failsafe(cited_sets(apply_verdicts(parse_verdicts(answers)))))


# --- sources -------------------------------------------------------------------------------------


def group_sources_by_document(sources: DataFrame, key: str = "answer_id") -> DataFrame:
    """One row per document an answer cites, in order of first appearance.

    ``sources(answer_id, index, document_id, filename, snippet, vector_id, cited_spans)``; an answer has
    a bounded number of sources.  Ids are compared in lower case.
    """
    doc = F.col("document_id").cast("string")
    group = F.coalesce(F.concat(F.lit("d"), doc), F.col("filename"), F.concat(F.lit("i"), F.col("index").cast("string")))
    label = F.coalesce(
        F.nullif("filename", F.lit("")),
        F.concat(F.lit(rules.GROUP_WORDING["numbered"]), doc),
        F.lit(rules.GROUP_WORDING["generic"]),
    )
    entry = F.struct("index", F.lower(F.nullif("vector_id", F.lit(""))).alias("id"), F.coalesce("cited_spans", F.array().cast("array<string>")).alias("spans"))
    grouped = sources.groupBy(key, group.alias("group_key")).agg(
        F.min("index").alias("first_index"),
        F.min_by("document_id", "index").alias("document_id"),
        F.min_by(label, "index").alias("label"),
        F.min_by("snippet", "index").alias("snippet"),
        F.array_sort(F.collect_list(entry)).alias("_entries"),
    )
    ids = F.array_distinct(F.filter(F.transform("_entries", lambda e: e["id"]), lambda i: i.isNotNull()))
    spans_of = lambda i: F.flatten(F.transform(F.filter("_entries", lambda e: e["id"] == i), lambda e: e["spans"]))
    return grouped.withColumn("cited_ids", ids).select(
        key,
        "group_key",
        "first_index",
        "document_id",
        "label",
        "snippet",
        "cited_ids",
        F.filter(
            F.transform("cited_ids", lambda i: F.struct(i.alias("id"), spans_of(i).alias("quotes"))),
            lambda s: F.size(s["quotes"]) > 0,
        ).alias("quotes"),
    )


def citation_position(chunks: DataFrame, cited: DataFrame, key: str = "document_id", index: str = "chunk_index") -> DataFrame:
    """Per document: number of chunks, number cited, and the 1-based position when exactly one is cited.

    ``cited(document_id, chunk_index)``.  Positions come from counting chunks up to the cited one, so no
    window runs over a whole document.
    """
    per_doc = cited.select(key, index).distinct().groupBy(key).agg(
        F.count(F.lit(1)).alias("n_cited"), F.min(index).alias("_at")
    )
    joined = chunks.select(key, index).join(per_doc, key, "left")
    return (
        joined.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.max(F.coalesce("n_cited", F.lit(0))).alias("n_cited"),
            F.count_if(F.col(index) <= F.col("_at")).alias("_pos"),
        )
        .select(key, "total", "n_cited", F.when(F.col("n_cited") == 1, F.col("_pos")).alias("position"))
    )


# --- quote highlighting --------------------------------------------------------------------------


def span_ranges(content: Column, quote: Column) -> Column:
    """All [start, end) code-point ranges of a quote, ignoring case and the kind of whitespace.

    Quotes shorter than three characters match nothing.
    """
    clean = py_strip(quote)
    word_list = F.filter(F.split(clean, r"(?U)\s+"), lambda w: w != "")
    pattern = F.concat(F.lit("(?iU)"), F.array_join(F.transform(word_list, regex_literal), "\\s+"))

    def locate(e: Column) -> Column:
        gaps = F.split(e["content"], e["pattern"], -1)
        hits = F.regexp_extract_all(e["content"], e["pattern"], F.lit(0))
        lengths = F.transform(
            hits, lambda h, i: F.struct(F.char_length(F.get(gaps, i)).alias("gap"), F.char_length(h).alias("hit"))
        )
        state = f"struct<at:int,out:array<{RANGE}>>"
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{RANGE}>").alias("out")).cast(state)

        def step(s: Column, x: Column) -> Column:
            start = s["at"] + x["gap"]
            return F.struct(
                (start + x["hit"]).alias("at"),
                F.concat(s["out"], F.array(F.struct(start.alias("start"), (start + x["hit"]).alias("end")).cast(RANGE))).alias("out"),
            ).cast(state)

        return F.aggregate(lengths, zero, step, lambda s: s["out"])

    found = let(F.struct(content.alias("content"), pattern.alias("pattern")), locate)
    return F.when(F.char_length(clean) >= 3, found).otherwise(F.array().cast(f"array<{RANGE}>"))


def quote_spans(pairs: DataFrame, keys: Sequence[str], content: str = "content", quote: str = "quote") -> DataFrame:
    """One row per occurrence of a quote in the chunk it is attached to."""
    return unnest(pairs, keys, span_ranges(F.col(content), F.col(quote)), "_n", "r").select(
        *keys, F.col("r.start").alias("start"), F.col("r.end").alias("end")
    )


def merge_ranges(ranges: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", width: int = 65536) -> DataFrame:
    """Merge overlapping or touching ranges per key.

    Equal starts are reduced first, so a section of ``width`` positions holds at most that many rows
    (for whole-number positions), whatever the size of the key.  Ranges merge to islands inside their
    section; then one summary row per section says how far earlier sections reach.  Islands that begin
    within that reach are the first ones of their section, and they all belong to the last island that
    was begun before them.  Rows whose start is null are left out; a null end counts as the start.
    """
    given = ranges.filter(F.col(start).isNotNull()).select(*keys, start, F.coalesce(end, start).alias(end))
    section = F.floor(F.col(start) / width).alias("_section")
    distinct = given.groupBy(*keys, section, start).agg(F.max(end).alias(end))
    inside = Window.partitionBy(*keys, "_section").orderBy(start)
    reach = F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    opened = distinct.withColumn("_open", F.when(reach.isNull() | (F.col(start) > reach), F.col(start)))
    placed = opened.withColumn("_island", F.max("_open").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    islands = placed.groupBy(*keys, "_section", F.col("_island").alias(start)).agg(F.max(end).alias(end))

    per_key = Window.partitionBy(*keys).orderBy("_section").rowsBetween(Window.unboundedPreceding, -1)
    sections = islands.groupBy(*keys, "_section").agg(F.max(start).alias("_last"), F.max(end).alias("_end"))
    sections = sections.withColumn("_reach", F.max("_end").over(per_key))
    begun = F.when(F.col("_reach").isNull() | (F.col("_last") > F.col("_reach")), F.col("_last"))
    sections = sections.withColumn("_head", F.max(begun).over(per_key)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_section").alias("_s"), "_reach", "_head")

    # Null keys are a group like any other, so the join takes them as equal.
    same = F.col("_section") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = islands.join(sections, same)
    head = F.when(F.col(start) <= F.col("_reach"), F.col("_head")).otherwise(F.col(start))
    return joined.groupBy(*keys, head.alias(start)).agg(F.max(end).alias(end))


def merged_in_row(ranges: Column) -> Column:
    """Merge the ranges of one chunk row."""
    kind = f"array<{RANGE}>"

    def step(done: Column, r: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end")).cast(RANGE)
        return F.when(
            (F.size(done) > 0) & (r["start"] <= last["end"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown)),
        ).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(ranges), F.array().cast(kind), step)


def highlight_segments(chunks: DataFrame, keys: Sequence[str], content: str = "content", quotes: str = "quotes") -> DataFrame:
    """Cut each chunk into marked and unmarked pieces; without any match the whole chunk is one marked piece.

    ``chunks(keys, content, quotes array<string>)``: the quotes of one answer for one chunk.
    """
    piece = "struct<text:string,mark:boolean>"

    def pieces(e: Column) -> Column:
        text, ms = e["text"], e["ranges"]
        cut = lambda a, b: F.substring(text, a + 1, b - a)

        def around(r: Column, i: Column) -> Column:
            before = F.coalesce(F.get(ms, i - 1)["end"], F.lit(0))
            return F.array(
                F.struct(cut(before, r["start"]).alias("text"), F.lit(False).alias("mark")).cast(piece),
                F.struct(cut(r["start"], r["end"]).alias("text"), F.lit(True).alias("mark")).cast(piece),
            )

        end = F.coalesce(F.get(ms, F.size(ms) - 1)["end"], F.lit(0))
        tail = F.struct(cut(end, F.char_length(text)).alias("text"), F.lit(False).alias("mark")).cast(piece)
        marked = F.filter(F.concat(F.flatten(F.transform(ms, around)), F.array(tail)), lambda p: p["text"] != "")
        whole = F.array(F.struct(text.alias("text"), F.lit(True).alias("mark")).cast(piece))
        return F.when(F.size(ms) > 0, marked).otherwise(whole)

    def with_ranges(text: Column) -> Column:
        found = F.flatten(F.transform(F.col(quotes), lambda q: span_ranges(text, q)))
        return let(F.struct(text.alias("text"), merged_in_row(found).alias("ranges")), pieces)

    segments = let(F.col(content), with_ranges)
    return unnest(chunks, keys, segments, "segment_no", "s").select(
        *keys, "segment_no", "s.text", "s.mark"
    )
