"""The columns that the registered queries derive, over the smallest table, against brute force."""

from __future__ import annotations

import hashlib

import pandas as pd
import pytest

import brute
from cases import SMALL
from plantpulse.llm.queries import QUERIES


@pytest.fixture(scope="module")
def table():
    return list(pd.read_parquet(f"{SMALL}/documents.parquet")[["doc_id", "text"]].itertuples(index=False, name=None))


def got(spark, name):
    found = {r.doc_id: r for r in QUERIES[name](spark, SMALL).collect()}
    return found


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_op2(spark, table):
    found = got(spark, "op2_lm_score")
    for doc_id, n_tokens, n_known, train, base, score in brute.lm_scores(table):
        r = found[doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (brute.held_out(doc_id, 7), n_tokens, n_known, train)
        assert (r.base_score, r.score) == pytest.approx((base, score), rel=1e-9)


def test_op7(spark, table):
    found = got(spark, "op7_personal_data")
    for doc_id, text in table:
        spans, r = brute.spans(text), found[doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in spans) for kind in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(",")) | {""}


def test_op8(spark, table):
    found = got(spark, "op8_language")
    lang = dict(pd.read_parquet(f"{SMALL}/documents.parquet")[["doc_id", "lang"]].itertuples(index=False, name=None))
    assert {k: r.held_out for k, r in found.items()} == {k: brute.held_out(k, 4) for k, _ in table}
    assert {r.lang_pred for r in found.values()} <= {*lang.values(), "und"} and all(0 <= r.score <= 1 for r in found.values())


def test_op10(spark, table):
    found = got(spark, "op10_substring_dedup")
    ordered = sorted(table)
    for (doc_id, text), (kept, n) in zip(ordered, brute.without_repeats([t for _, t in ordered]), strict=True):
        r, size = found[doc_id], len((text or "").encode())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, size - len(kept), n, sha(kept))
