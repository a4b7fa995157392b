"""Brute-force checks for queries without a SQL oracle: plain Python over the
small test tables, compared row by row."""

import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from sparkprep.functions.stem import stem_token
from sparkprep.functions.tokens import CONTRACTION_RULES
from sparkprep.plans.registry import all_queries

SF = "/root/testdata/sf0.001"

_RULES = [(re.compile(p), r.replace("$1", r"\1").replace("$2", r"\2").replace("$3", r"\3"))
          for p, r in CONTRACTION_RULES]


def _tokens(text, stem):
    t = text.strip().strip('"')
    for p, r in _RULES:
        t = p.sub(r, t)
    toks = [x for x in re.sub(r"[^a-z0-9]+", " ", t.lower()).split(" ") if x]
    return [stem_token(x) for x in toks] if stem else toks


def _rouge(hyp, ref, stem):
    h, r = Counter(_tokens(hyp, stem)), Counter(_tokens(ref, stem))
    o = sum((h & r).values())
    p = o / max(sum(h.values()), 1)
    rc = o / max(sum(r.values()), 1)
    f = 2 * p * rc / (p + rc) if p + rc > 0 else 0.0
    return round(p, 6), round(rc, 6), round(f, 6)


@pytest.mark.parametrize("name,stem", [("ag3_rouge1", False), ("ag3_rouge1_stemmed", True)])
def test_rouge_against_python(spark, name, stem):
    conv = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    by_key = {(c["conv_id"], c["turn"]): c["text"] for c in conv}
    want = {}
    for (cid, turn), hyp in by_key.items():
        ref = by_key.get((cid, turn + 1))
        if ref is not None:
            want[cid * 100 + turn] = _rouge(hyp, ref, stem)
    got = {r.pair_id: (r.precision, r.recall, r.f1) for r in all_queries()[name].build(spark, SF).collect()}
    assert got == want


from hypothesis import given, settings, strategies as st  # noqa: E402

_WORDS = st.lists(st.sampled_from(["a", "b", "ab", "the", "cat", "Cat!", "x1", "42", "don't", "cannot"]),
                  max_size=30).map(" ".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(_WORDS, _WORDS), min_size=1, max_size=25))
def test_rouge_merge_matches_python_counter(spark, pairs):
    from sparkprep.operators.score import rouge1
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "pair_id long, hyp string, ref string")
    got = {r.pair_id: (r.precision, r.recall, r.f1) for r in rouge1(df).collect()}
    assert got == {i: _rouge(h, r, False) for i, (h, r) in enumerate(pairs)}
