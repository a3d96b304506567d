"""What must hold of the rows of the text queries on the smallest tables."""

import pytest

from rideloom.common import table
from rideloom.llm import pii, plans, tokens


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r.doc_id: r for r in table(spark, small, "documents").collect()}


def test_ids_decode_to_the_texts(spark, small, docs):
    rows = plans.p8_ids(spark, small).collect()
    assert {r.doc_id for r in rows} == docs.keys() and len(rows) == len(docs)
    assert all(tokens.decode(r.ids, tokens.vocabulary()).decode() == (docs[r.doc_id].text or "") for r in rows)


def test_tokens_by_source_add_up(spark, small, docs):
    rows, ids = plans.p8_tokens(spark, small).collect(), plans.p8_ids(spark, small).collect()
    assert sum(r.documents for r in rows) == len(docs) and sum(r.tokens for r in rows) == sum(len(r.ids) for r in ids)
    assert sum(r.chars for r in rows) == sum(len(d.text or "") for d in docs.values())


def test_mix_keeps_caps_and_reports_itself(spark, small, docs):
    drawn, shares = plans.p9_mix(spark, small).collect(), {r.source: r for r in plans.p9_shares(spark, small).collect()}
    caps = {r.source: r.max_repeats for r in table(spark, small, "mix_targets").collect()}
    assert shares.keys() == caps.keys() and all(r.copy < caps[r.source] and docs[r.doc_id].source == r.source for r in drawn)
    assert len({(r.doc_id, r.copy) for r in drawn}) == len(drawn) and [r.place for r in drawn] == sorted(r.place for r in drawn)
    total = sum(r.tokens for r in drawn)
    assert all(abs(s.share - sum(r.tokens for r in drawn if r.source == k) / total) < 1e-9 for k, s in shares.items())


def test_spans_lie_in_the_texts_and_are_masked(spark, small, docs):
    spans, masked = plans.p10_found(spark, small).collect(), {r.doc_id: r.text for r in plans.p10_redacted(spark, small).collect()}
    by_doc = {}
    for r in spans:
        assert r.kind in pii.KINDS and 0 <= r.start_char < r.end_char <= len(docs[r.doc_id].text)
        by_doc.setdefault(r.doc_id, []).append((r.start_char, r.end_char, r.kind))
    assert masked.keys() == docs.keys() and len(spans) > 90
    for k, d in docs.items():
        own = sorted(by_doc.get(k, []))
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:])) and masked[k] == pii.masked(d.text, own)
