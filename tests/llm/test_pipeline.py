import hashlib
import re
from collections import Counter

import corpus_pipeline
import pyarrow.parquet as pq
import test_jaccard
import test_lines
import test_mixing
from tokenizers import Tokenizer

from corpusloom.llm import mixing, quality
from corpusloom.llm.common import tokenizer_file

SF = "/root/testdata/sf0.001"


def plain(rows):
    """The pipeline over dictionaries, stage by stage."""
    references = {}
    for r in rows:
        raw, key = (r["text"] or "").encode(), quality.language_key(r["lang"])
        for kind, counts in (("class", quality.class_counts(raw)), ("word", quality.word_counts(raw, key))):
            references[key, kind] = references.get((key, kind), 0) + counts
    rows = [r for r in rows if quality.judge(r["text"], r["lang"], references, quality.limits())[-1]]
    kept = {d: t for d, t, _, _ in test_lines.brute([(r["doc_id"], r["text"]) for r in rows], 10)}
    rows = [r | {"text": kept[r["doc_id"]], "n_chars": len(kept[r["doc_id"]])} for r in rows]
    classes = {d: c for d, _, c in test_jaccard.brute([(r["doc_id"], r["text"]) for r in rows])}
    rows = [r for r in rows if classes[r["doc_id"]] == r["doc_id"]]
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows}
    sources = Counter()
    for r in rows:
        sources[r["source"]] += size[r["doc_id"]]
    targets, before, out = test_mixing.targets(dict(sources)), Counter(), []
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    for r in sorted(rows, key=lambda r: hashlib.md5(f"{r['doc_id']}{mixing.ORDER}".encode()).hexdigest()):
        s, n = r["source"], size[r["doc_id"]]
        passes = sum(before[s] + n / 2 + k * sources[s] <= targets[s] for k in range(3))
        before[s] += n
        ids = library.encode(r["text"], add_special_tokens=False).ids
        out += [(r["doc_id"], len(ids), tuple(ids), hashlib.sha256(r["text"].encode()).hexdigest())] * passes
    return Counter(out)


def test_pipeline_against_a_plain_version(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == plain(rows)
    assert sum(got.values()) > 50 and max(got.values()) > 1


def test_stages_keep_the_columns_of_documents_and_take_odd_rows(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources", "BPE encoding"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "the cat and a dog sat " + " ".join(f"w{i}" for i in range(100))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, None, None, None, None), (3, "", "", "", 0), (None, text + " more words", "en", None, 5), (4, text * 300, "xx", "b", 9)]
    for odd in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = odd
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd.columns
            assert [f.dataType for f in docs.schema] == [f.dataType for f in odd.schema]
            docs.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_near_duplicate_stage_keeps_one_row_of_each_component(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(100))
    a, b, c, d, e = map(text, "abcde")
    rows = [(None, a), (None, a), (None, b), (1, c), (1, c), (None, c + " more"), (2, d), (3, d + " more"), (3, e), (3, d), (4, None), (4, None), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(None, a), (None, b), (1, c), (2, d), (3, e), (4, None), (4, None), (None, ""), (None, None)])
