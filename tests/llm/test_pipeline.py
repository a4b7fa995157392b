"""The corpus pipeline over a whole small table, stage by stage against brute force."""

from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from sparkprep.llm import mixing
from sparkprep.llm.common import saved, table
from sparkprep.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """name -> rows, of the input and after each stage but the last."""
    docs = table(spark, SF, "documents")
    out = {"input": docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == table(spark, SF, "documents").columns
        out[name] = docs.collect()
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def test_toxic_documents_go_and_others_stay(stages):
    before, after = Counter(stages["input"]), Counter(stages["toxicity"])
    assert not after - before and sum(after.values()) > 0.8 * sum(before.values())


def test_one_document_of_each_group_stays(stages):
    rows = stages["toxicity"]
    sets = [shingles(r.text) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(root(k), []).append(r)
    kept = Counter(stages["near_duplicates"])
    assert sum(kept.values()) == len(groups) < len(rows)
    for group in groups.values():
        assert sum(min(kept[r], n) for r, n in Counter(group).items()) == 1


def test_benchmark_passages_go(spark, stages):
    grams = set()
    for r in table(spark, SF, "benchmark").collect():
        w = (r.text or "").lower().split()
        grams |= {tuple(w[i:i + 11]) for i in range(len(w) - 10)}
    holds = lambda t: any(tuple(w[i:i + 11]) in grams for w in [(t or "").lower().split()] for i in range(len(w) - 10))
    before, after = stages["near_duplicates"], set(stages["decontamination"])
    assert not any(holds(r.text) for r in after)
    gone = [r for r in before if r not in after]
    assert any(holds(r.text) for r in gone) and len(gone) < 0.3 * len(before)


def test_sources_come_near_their_targets(spark, stages):
    docs = spark.createDataFrame(stages["decontamination"], table(spark, SF, "documents").schema)
    target = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    words, longest = Counter(), Counter()
    for r in stages["mixing"]:
        n = len((r.text or "").split())
        words[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    for source, wanted in target.items():
        assert abs(words[source] - wanted) <= max(longest[source], 1) * 1.5, source


def test_run_writes_every_token_of_the_mix_once(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    tokens = sum(len(sp.encode(r.text or "")) + 1 for r in stages["mixing"])     # an end after each text
    assert sum(r.n_tokens for r in rows) == tokens
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
