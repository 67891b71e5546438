"""Queries over whole tables: no rows left out before the operator."""

import catalog
from catalog.data import table

SF = "/root/testdata/sf0.001"


def test_no_answer_and_no_document_is_left_out(spark):
    catalog.load_all()
    from catalog.citations import _replies

    answers = {r.answer_id for r in _replies(spark, SF).select("answer_id").collect()}
    applied = catalog.QUERIES["apply_verdicts_all"](spark, SF).collect()
    broken = {r.answer_id for r in applied if r.broken}
    assert {r.answer_id for r in applied} == answers and broken
    assert all(r.dropped_count == 0 for r in applied if r.broken)
    assert broken & {r.answer_id for r in catalog.QUERIES["cited_sets_all"](spark, SF).collect()}
    labelled = {r.doc_id for r in table(spark, SF, "labels", "doc_id").collect()}
    assert {r.chunk_id for r in catalog.QUERIES["pool_documents"](spark, SF).collect()} - labelled
