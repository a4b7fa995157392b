import pytest
from pyspark.sql import functions as F

from sparkprep.functions.stem import porter_stem
from sparkprep.operators.lengths import pack, truncate_left
from sparkprep.operators.pairs import fit_pair, pairs_by_gap
from sparkprep.operators.score import number_accuracy, rouge1


def _rouge(spark, pairs, **kw):
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "pair_id long, hyp string, ref string")
    return {r.pair_id: r for r in rouge1(df, **kw).collect()}


def test_rouge_goldens(spark):
    got = _rouge(spark, [
        ("the cat sat", "the cat sat"),            # identical
        ("dog", "cat"),                            # disjoint
        ("the the cat", "the cat cat dog"),        # overlap 2: P 2/3, R 2/4
        ("", "something"),                         # empty hypothesis
        ('  "Quoted, Text!" ', "quoted text"),     # strip + quotes + case + punctuation
        ("I don't know", "i do n't know"),         # contraction split
    ])
    assert got[0].f1 == 1.0 and got[1].f1 == 0.0
    assert (got[2].overlap, got[2].precision, got[2].recall) == (2, round(2 / 3, 6), 0.5)
    assert got[2].f1 == round(2 * (2 / 3) * 0.5 / (2 / 3 + 0.5), 6)
    assert got[3].f1 == 0.0 and got[3].n_hyp == 0
    assert got[4].f1 == 1.0
    assert got[5].f1 == 1.0 and got[5].n_hyp == 5


def test_rouge_f_symmetric_and_bounded(spark):
    pairs = [("a b c d", "b c e"), ("x y", "y z z"), ("one two", "three")]
    fwd = _rouge(spark, pairs)
    bwd = _rouge(spark, [(r, h) for h, r in pairs])
    for i in fwd:
        assert fwd[i].f1 == bwd[i].f1 and 0.0 <= fwd[i].f1 <= 1.0


def test_rouge_stemmed(spark):
    got = _rouge(spark, [("cats running quickly", "cat runs quick")], stem=True)
    assert got[0].overlap == 2  # cat(s), run(ning/s); quickli != quick


@pytest.mark.parametrize("word,stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
    ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
    ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"),
    ("relational", "relat"), ("conditional", "condit"), ("hopefulness", "hope"),
    ("generalization", "gener"), ("replacement", "replac"), ("adoption", "adopt"), ("controlling", "control"),
])
def test_porter(word, stem):
    assert porter_stem(word, mode="original") == stem


@pytest.mark.parametrize("word,original,extended", [
    ("dies", "di", "die"), ("ties", "ti", "tie"), ("lying", "ly", "lie"), ("skies", "ski", "sky"),
    ("cried", "cri", "cri"), ("died", "di", "die"), ("news", "new", "news"), ("analogi", "analogi", "analog"),
    ("hopefulli", "hopefulli", "hope"), ("sensibli", "sensibli", "sensibl"), ("cats", "cat", "cat"),
])
def test_porter_modes(word, original, extended):
    assert porter_stem(word, mode="original") == original
    assert porter_stem(word) == extended


def test_stem_column_equals_the_plain_function(spark):
    import random
    from sparkprep.functions.stem import _IRREGULAR, _STEP2_EXTENDED, _STEP3, _STEP4, stem_column
    rnd = random.Random(1)
    ends = [s for s, _ in _STEP2_EXTENDED + _STEP3] + _STEP4 + ["ies", "sses", "s", "ied", "eed", "ed", "ing", "y", "yy", "ll", "e"]
    words = {"".join(rnd.choice("aeiouybcdlstzwvx1\u00e9") for _ in range(rnd.randrange(0, 6)))
             + "".join(rnd.choice(ends) for _ in range(rnd.randrange(1, 3))) for _ in range(6000)} | set(_IRREGULAR) | {"", "a"}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "w string")
    for mode in ("extended", "original"):
        for r in df.select("w", stem_column(F.col("w"), mode).alias("s")).collect():
            assert r.s == (porter_stem(r.w, mode) if len(r.w) > 3 else r.w), r.w


def test_stemmed_rouge_runs_no_python(spark):
    df = spark.createDataFrame([(1, "running cats", "cat runs")], "pair_id long, hyp string, ref string")
    plan = rouge1(df, stem=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_number_accuracy(spark):
    preds = spark.createDataFrame([(0, "total 1,000"), (1, "x 5 and 6"), (2, "got 7"), (3, "n/a")],
                                  "idx long, text string")
    gold = spark.createDataFrame([(0, "1000", 0), (1, "5", 0), (2, "7", 1), (3, "3", 1), (4, "9", 1)],
                                 "idx long, gt string, num_type int")
    got = {r.num_type: (r.n, r.n_correct, r.accuracy) for r in number_accuracy(preds, gold).collect()}
    assert got == {0: (2, 1, 0.5), 1: (3, 1, round(1 / 3, 6)), None: (5, 2, 0.4)}


def test_pack_conserves_tokens(spark):
    rows = [(i, " ".join(f"t{i}_{j}" for j in range(i % 13))) for i in range(120)]
    df = spark.createDataFrame(rows, "idx long, text string")
    all_toks = [t for _, s in rows for t in s.split()]
    blocks = pack(df, "text", ["idx"], 16, keep_partial=True).orderBy("block_id").collect()
    assert [t for b in blocks for t in b.tokens] == all_toks
    full = pack(df, "text", ["idx"], 16).collect()
    assert len(full) == len(all_toks) // 16 and all(b.n_tokens == 16 for b in full)


def test_truncate_left(spark):
    df = spark.createDataFrame([("a b  c\td",), ("",), ("x",)], "t string")
    assert [r[0] for r in df.select(truncate_left("t", 2)).collect()] == ["c\td", "", "x"]


def test_fit_pair(spark):
    mk = lambda n, p: " ".join(f"{p}{i}" for i in range(n))
    df = spark.createDataFrame([(0, mk(10, "p"), mk(3, "c"), mk(2, "r")),
                                (1, mk(10, "p"), mk(9, "c"), mk(2, "r")),
                                (2, mk(4, "p"), mk(2, "c"), mk(2, "r"))],
                               "id int, prompt string, chosen string, rejected string")
    got = {r.id: r for r in fit_pair(df, 4, 8).collect()}
    assert (got[0].prompt_tokens, got[0].chosen_tokens) == (4, 3) and got[0].prompt == "p6 p7 p8 p9"
    assert (got[1].prompt_tokens, got[1].chosen_tokens, got[1].rejected_tokens) == (4, 4, 2)
    assert (got[2].prompt_tokens, got[2].chosen_tokens) == (4, 2)


def test_texts_within_budget_stay_as_they_are(spark):
    text = "<s>system\nx  y</s>\n"
    df = spark.createDataFrame([(1, text, " a\tb \n", None), (2, text, text, text)],
                               "id int, prompt string, chosen string, rejected string")
    got = sorted(fit_pair(df, 4, 8).collect(), key=lambda r: r.id)
    assert (got[0].prompt, got[0].chosen, got[0].rejected) == (text, " a\tb \n", None)
    assert (got[1].prompt, got[1].chosen, got[1].rejected) == (text, text, text)
    assert got[1].prompt_tokens == 3 and got[1].chosen_tokens == 3
    assert [r[0] for r in df.select(truncate_left("chosen", 3)).collect()] == [" a\tb \n", text]


def test_adverbs_share_the_stem_of_their_adjectives():
    from sparkprep.functions.stem import porter_stem
    assert [porter_stem(w) for w in ("additionally", "additional", "conditionally", "conditional")] == \
        ["addit", "addit", "condit", "condit"]
    assert porter_stem("carelessly") == "carelessli" and porter_stem("really") == "realli"


CUTS = ["a b  c\td", "", "x", " \n lead \u3000 and trail \t ", "\u00e9\u00e8 \U0001f389x \u4e2d\u6587 end", None, "   ", "one\x1ctwo\x85three"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50])
def test_word_cuts_are_true_suffixes_and_prefixes(spark, n):
    import re
    from sparkprep.functions.tokens import WORDS
    df = spark.createDataFrame([(t,) for t in CUTS], "t string")
    got = df.select("t", WORDS.last("t", n).alias("last"), WORDS.first("t", n).alias("first")).collect()
    for r in got:
        spans = [m.span() for m in re.finditer(r"\S+", r.t)] if r.t is not None else []
        if len(spans) <= n:
            assert (r.last, r.first) == (r.t, r.t)
        else:
            assert r.last == (r.t[spans[-n][0]:] if n else "")
            assert r.first == (r.t[:spans[n - 1][1]] if n else "")


def _hooks():
    import public_tokenizers
    from sparkprep.functions.tokens import piece_model_file, tokenizer_file, utf8_tokens
    return {"utf8": utf8_tokens, "json": lambda: tokenizer_file(public_tokenizers.path("byte_bpe_50k.json")),
            "model": lambda: piece_model_file(public_tokenizers.path("piece_bpe_32k.model"))}


def _encode(name, text):
    """(ids, spans) by the library itself, one text at a time."""
    import public_tokenizers
    if name == "utf8":
        return [b + 3 for b in text.encode()], [(i, i + 1) for i, c in enumerate(text) for _ in c.encode()]
    if name == "json":
        from tokenizers import Tokenizer
        e = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False)
        return e.ids, e.offsets
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = sp.encode(text, return_type="proto").pieces
    raw = text.encode()
    at = lambda b: len(raw[:b].decode(errors="ignore"))
    up = lambda e: next(k for k in range(len(text) + 1) if len(text[:k].encode()) >= e)
    return sp.encode(text), [(at(p.begin), up(p.end) if p.end > p.begin else at(p.begin)) for p in pieces]


@pytest.mark.parametrize("name", ["utf8", "json", "model"])
def test_token_hook_ids_counts_and_cuts(spark, name):
    hook = _hooks()[name]()
    df = spark.createDataFrame([(t,) for t in CUTS], "t string").repartition(3)
    got = df.select("t", hook.array("t").alias("ids"), hook.count("t").alias("n"), truncate_left("t", 4, hook).alias("last"),
                    hook.first("t", 4).alias("first")).collect()
    assert len(got) == len(CUTS)
    for r in got:
        if r.t is None:
            assert (r.ids, r.n, r.last, r.first) == (None, None, None, None)
            continue
        ids, spans = _encode(name, r.t)
        assert r.ids == list(ids) and r.n == len(ids)
        cut = len(ids) > 4
        assert r.last == (r.t[spans[-4][0]:] if cut else r.t)
        assert r.first == (r.t[:spans[3][1]] if cut else r.t)


def test_pair_budget_in_ids(spark):
    from sparkprep.functions.tokens import utf8_tokens
    df = spark.createDataFrame([(1, "p\u00e9" * 10, "c" * 3, "r\u4e2d" * 4), (2, "pp", "cc", None)],
                               "id int, prompt string, chosen string, rejected string")
    got = {r.id: r for r in fit_pair(df, 6, 10, tokens=utf8_tokens()).collect()}
    assert (got[1].prompt, got[1].prompt_tokens) == ("p\u00e9" * 2, 6)
    assert (got[1].chosen, got[1].rejected) == ("ccc", "r\u4e2d") and (got[1].chosen_tokens, got[1].rejected_tokens) == (3, 4)
    assert (got[2].prompt, got[2].chosen, got[2].rejected) == ("pp", "cc", None)


def test_pack_of_ids_under_hash_and_null_keys(spark):
    from sparkprep.functions.tokens import utf8_tokens
    import random
    rnd = random.Random(2)
    rows = [(rnd.randrange(-2 ** 63, 2 ** 63) if i else None, f"text {i} \u00e9" * (i % 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "h long, text string")
    blocks = pack(df, "text", ["h"], 64, keep_partial=True, tokens=utf8_tokens()).orderBy("block_id").collect()
    stream = [b + 3 for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for b in t.encode()]
    assert [t for b in blocks for t in b.tokens] == stream
    assert all(b.n_tokens == 64 for b in blocks[:-1])


def test_pack_reads_its_input_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "w " * i) for i in range(50)], "idx long, text string")
    df.write.parquet(str(tmp_path / "in"))
    plan = pack(spark.read.parquet(str(tmp_path / "in")), "text", ["idx"], 16)._jdf.queryExecution().optimizedPlan().toString()
    assert str(tmp_path) not in plan and plan.count("Relation") == 1


def test_pairs_by_gap_ties_lowest_rep(spark):
    df = spark.createDataFrame([(1, 1, 0.5, "a"), (1, 2, 0.5, "b"), (1, 3, 0.1, "c"), (1, 4, 0.1, "d"),
                                (2, 1, 0.3, "e"), (2, 2, 0.29, "f")],
                               "idx long, rep long, score double, candidate string")
    got = {r.idx: r for r in pairs_by_gap(df, 0.05, prompt=None).collect()}
    assert set(got) == {1} and (got[1].chosen, got[1].rejected, got[1].chosen_rep, got[1].rejected_rep) == ("a", "c", 1, 3)


def test_pluggable_token_counter(spark):
    from sparkprep.functions.tokens import pandas_token_counter, token_count
    df = spark.createDataFrame([("a b  c",), ("",), (None,), ("one",)], "t string")
    counter = pandas_token_counter(lambda: (lambda s: s.split()))
    got = [r[0] for r in df.select(counter("t")).collect()]
    assert got == [3, 0, None, 1]
    assert [r[0] for r in df.select(token_count("t")).collect()] == [3, 0, None, 1]


def test_tokenizer_file_counter(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers
    from sparkprep.functions.tokens import tokenizer_file_counter
    from sparkprep.operators.lengths import length_profile
    from sparkprep.operators.messages import build_messages
    tok = Tokenizer(models.WordPiece(unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    texts = ["the headline has 5 words", "news about numbers and words", "a b c"]
    tok.train_from_iterator(texts, trainers.WordPieceTrainer(vocab_size=60, special_tokens=["[UNK]"]))
    path = str(tmp_path / "tok.json")
    tok.save(path)
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    counter = tokenizer_file_counter(path)
    got = [r[0] for r in df.select(counter("t")).collect()]
    assert got == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts] + [None]
    ex = spark.createDataFrame([(0, texts[0], "h 5")], "idx long, news string, headline string")
    prof = length_profile(build_messages(ex, "hg"), counter=counter).first()
    assert prof.max_assistant_tokens == len(tok.encode("h 5", add_special_tokens=False).ids)


def test_rouge_merge_and_aggregate_methods_agree(spark):
    rows = [(i, ("word%d " % (i % 7)) * (i % 40) + "the end", "the end " + ("word%d " % (i % 5)) * (i % 30))
            for i in range(120)] + [(500, None, "x y"), (501, "", ""), (502, "b a b a c", "a b c c")]
    df = spark.createDataFrame(rows, "pair_id long, hyp string, ref string")
    merge = {r.pair_id: tuple(r[1:]) for r in rouge1(df).collect()}
    agg = {r.pair_id: tuple(r[1:]) for r in rouge1(df, method="aggregate").collect()}
    assert merge == agg and len(merge) == 123
    assert merge[502][0] == 3  # {a, b, c} with b twice in hyp, c twice in ref


def test_token_hook_gives_its_tokenizer_few_texts_at_a_time(spark):
    from sparkprep.functions.tokens import TokenHook

    def make():
        def batch(texts):
            if len(texts) > 1000 or len(texts) > 1 and sum(map(len, texts)) > 1 << 20:
                raise ValueError("too many texts together")
            return [([ord(c) for c in t], list(range(len(t))), list(range(1, len(t) + 1))) for t in texts]
        return batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    hook = TokenHook(make)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 4 << 20
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")         # whatever the batches are
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    df = spark.range(0, 3000, 1, 1).selectExpr(
        "id", "CASE WHEN id % 7 = 0 THEN NULL WHEN id = 1 THEN repeat('y', 2000000) ELSE repeat('x', cast(id as int)) END AS t")
    got = df.select("id", hook.count("t").alias("n"), F.length(hook.last("t", 5)).alias("last"),
                    F.length(hook.first("t", 5)).alias("first"), F.size(hook.array("t")).alias("ids")).collect()
    for r in got:
        n = None if r.id % 7 == 0 else 2_000_000 if r.id == 1 else r.id
        assert r.n == n and (n is None or r.ids == n)
        assert r.last == r.first == (None if n is None else min(n, 5))


def test_counts_and_cuts_hand_back_no_tokens(spark):
    from sparkprep.functions.tokens import utf8_tokens
    df = spark.createDataFrame([(1, "p", "c", "r")], "id int, prompt string, chosen string, rejected string")
    plan = fit_pair(df, 6, 10, tokens=utf8_tokens())._jdf.queryExecution().optimizedPlan()
    udfs = [a.dataType().simpleString() for a in _outputs(plan, "ArrowEvalPython")]
    assert len(udfs) == 6 and not [t for t in udfs if "array" in t]


def _outputs(plan, node):
    """Attributes that the Python steps of a plan add."""
    got = []
    if plan.nodeName() == node:
        attrs = plan.resultAttrs()
        got += [attrs.apply(i) for i in range(attrs.size())]
    children = plan.children()
    for i in range(children.size()):
        got += _outputs(children.apply(i), node)
    return got
