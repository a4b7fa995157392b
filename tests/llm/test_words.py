"""Spelling variants, reversed search and byte-level BPE against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sparkprep.llm import bpe, search, spelling
from sparkprep.llm.queries import tokenizer

SCHEMA = "doc_id long, text string"
ITEMS = "item_id long, text string"
rnd = random.Random(11)
STEMS = ["information", "understanding", "über-straße", "señorita", "letters", "aaaaaaaa", "bananas"]


def misspelt(w):
    k, c = rnd.randrange(len(w)), rnd.choice("abñ")
    return rnd.choice([w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + c + w[k + 1:]])


def spelling_rows():
    texts = []
    for i in range(60):
        ws = [rnd.choice(STEMS) for _ in range(40)] + [misspelt(rnd.choice(STEMS)) for _ in range(12)]
        texts.append((i, " ".join(ws) + " ÀBCDEFGH×÷ Short 12"))
    long_run = "abcdefgh" * 20_000
    return texts + [(3, texts[3][1]), (None, "Information lettersx lettersx"), (70, None), (71, ""),
                    (72, long_run), (73, long_run + " " + long_run + "x " + long_run + "x")]


def spelling_by_hand(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]

    form, n_near = {}, {}
    for w in counts:
        others = [v for v in counts if near(w, v)]
        n_near[w] = len(others)
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 10 * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w), root(w), counts[w], n_near[w], counts[form[w]] if w in form else None) for w in counts)


def as_rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_spelling_variants_match_brute_force(spark):
    rows = spelling_rows()
    expected = spelling_by_hand(rows)
    assert any(r[1] for r in expected) and any(r[4] > 1 for r in expected)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert as_rows(spelling.groups(docs), *COLUMNS) == expected
    clashing = docs.withColumns({c: F.lit("x") for c in ("word", "n", "w", "kind", "form", "f_range", "_key")})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")    # many ranges
    try:
        assert as_rows(spelling.groups(clashing), *COLUMNS) == expected
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_roots_follow_long_chains(spark):
    # each word is near the next one only, which occurs ten times as often
    words = [("a" * (7 + i), 10 ** i) for i in range(15)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    for i, (w, n) in enumerate(words):
        assert got[w].root == words[-1][0]
        assert got[w].form == (words[i + 1][0] if i < 14 else None)
        assert got[w].n_near == (1 if i in (0, 14) else 2)


def test_trie_numbers_agree_across_ranges():
    """Cut a sorted list anywhere: equal prefixes get equal numbers, others different ones."""
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 7))) for _ in range(120)})
    for cuts in ([], [1], [5, 6, 7], [40, 80], list(range(1, len(words)))):
        ranges = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)])]
        ends, own = [], {}
        for r, part in enumerate(ranges):
            last, path, node = None, [], 0
            for w in part:
                shared = spelling.common_prefix(last, w) + 1 if last is not None else 0
                path = path[:shared] + list(range(node, node + len(w) + 1 - shared))
                node, last = node + len(w) + 1 - shared, w
                own[w] = (r, path)
            ends.append((r, part[0], part[-1], path, node - 1))
        import numpy as np
        known, numbers = spelling.join_ranges(ends), {}
        for w, (r, path) in own.items():
            got = spelling.path_numbers(np.array(path), np.full(len(path), r), known)
            for k, x in enumerate(got.tolist()):
                assert numbers.setdefault(w[:k], x) == x
        assert len(set(numbers.values())) == len(numbers)


def test_spelling_of_an_empty_table(spark):
    assert spelling.groups(spark.createDataFrame([], SCHEMA)).count() == 0


# ---------------------------------------------------------------------------
VOCAB = ["alpha", "Beta", "gamma7", "δέλτα", "x", "the", "of", "zeta-eta", "9"]


def search_rows():
    docs = [(i, " ".join(rnd.choice(VOCAB) for _ in range(rnd.randrange(1, 30)))) for i in range(200)]
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, "the alpha"), (None, "the alpha"), (300, None), (301, ""),
             (302, " ,;- "), (303, "alpha " * 200_000), (304, docs[7][1]), (305, docs[7][1])]
    items = [(1, "alpha beta"), (2, "ZETA of the of the"), (3, None), (4, ""), (5, "unknown words"), (6, "δέλτα"),
             (7, " ".join(VOCAB)), (7, "x"), (None, "Gamma7")]
    return docs, items


def search_by_hand(docs, items, k=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = 0
            for t in set(terms(text)) & c.keys():
                df = sum(t in d for _, d in held)
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [search.BLOCK, 8])
def test_search_matches_brute_force(spark, block):
    docs, items = search_rows()
    d = spark.createDataFrame(docs, SCHEMA).withColumns({c: F.lit(0) for c in ("n", "t", "tf", "score", "rank", "item")})
    i = spark.createDataFrame(items, ITEMS).withColumns({c: F.lit("y") for c in ("doc_id", "size", "item", "at")})
    got = search.search(d, i, block=block).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == search_by_hand(docs, items)


def test_scores_of_items_with_very_many_terms_are_added_as_integers(monkeypatch, spark):
    docs, items = search_rows()
    monkeypatch.setattr(search, "_EXACT_TERMS", 1)
    got = search.search(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS))
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == search_by_hand(docs, items)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "alpha")], ITEMS)
    assert search.search(docs, items).count() == 0
    assert search.search(docs, one).count() == 0
    assert search.search(one.withColumnRenamed("item_id", "doc_id"), items).count() == 0


# ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokens():
    return bpe.read_ranks(tokenizer("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(tokens):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks={t: i for i, t in enumerate(tokens)})


def odd_texts():
    alphabet = " \n\t\r\x0b\x1c\x85\xa0　'sS't09²½٣aàéß中文字🎉👩‍👩‍👧abcabc   !!--_.,́​"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 60))) for _ in range(3000)]
    return texts + ["a" * 5000, " " * 3000, "\n" * 2000 + "x", " \n \n a b  c   d ", "<|endoftext|> don't WE'LL",
                    "".join(rnd.choice("abcdeo") for _ in range(200_000)), "plain words again " * 100_000]


def test_replay_matches_the_library(tokens, library):
    encoder = bpe.Encoder(bpe.Merges(tokens), {}, public_tokenizers.PATTERN)
    import numpy as np
    texts = odd_texts()
    for text, got in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(got, dtype=np.int32).tolist() == library.encode_ordinary(text), ascii(text[:80])


def test_replay_goes_back_to_a_lower_rank():
    """'bc' joins first only in part of the words, and then makes 'abc', of a lower rank."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"abcbc"]
    merges = bpe.Merges(tokens)
    encoding = tiktoken.Encoding("small", pat_str=r"\S+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for word in ("abc", "abcabc", "xabcbcabc", "bcbcabcbc", "a", ""):
        ids = merges.replay([word.encode(), b"zabcabcbc"])
        assert ids == [encoding.encode_ordinary(word), encoding.encode_ordinary("zabcabcbc")]


def test_encode_and_decode_round_trip(spark, tokens, library):
    texts = [*odd_texts()[-40:], "the same text", "the same text"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (900, None), (901, "")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("ids", "token", "freq", "bytes")})
    expected = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)
    for head in (bpe.HEAD, 5):
        got = bpe.decode(bpe.encode(docs, tokens, public_tokenizers.PATTERN, head), tokens)
        assert sorted(((r.doc_id, r.ids, bytes(r.bytes)) for r in got.collect()), key=str) == expected
    digests = {r.doc_id: r for r in bpe.digests(got).collect()}
    for i, ids, raw in expected:
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(raw).hexdigest()


def test_bpe_of_an_empty_table(spark, tokens):
    docs = spark.createDataFrame([], SCHEMA)
    assert bpe.digests(bpe.decode(bpe.encode(docs, tokens, public_tokenizers.PATTERN), tokens)).count() == 0


def test_patterns_with_other_escapes_use_the_full_matcher(library):
    assert bpe.latin_pattern(r"\w+|\d") is None
    assert bpe.latin_pattern(r"[^\S]") is None
    split = bpe.splitter(r"\w+|\W")
    assert split("ab, ç") == ["ab", ",", " ", "ç"]


def test_rank_files_are_checked(tmp_path):
    (tmp_path / "bad").write_bytes(b"YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "bad"))
