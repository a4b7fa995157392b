"""Looking up token ids batch by batch, against the tokenizer itself."""

import random

import pyarrow as pa
import pytest
import sentencepiece

from sparkprep.llm import shards
from sparkprep.llm.queries import tokenizer

PATH = tokenizer("piece_bpe_32k.model")
ODD = [None, "", " ", "   ", "a", " a", "a ", "a  b", "▁", "a▁b ▁ c", "é ñ\n\nx\ty", "日本 語", "😀 a\x00b", "\n", "x" * 300]


class Counted:
    """A tokenizer that notes the words it is given."""

    def __init__(self, sp):
        self.sp, self.seen = sp, []

    def piece_to_id(self, piece):
        return self.sp.piece_to_id(piece)

    def encode(self, words, **options):
        self.seen += words
        return self.sp.encode(words, **options)


@pytest.mark.parametrize("limit", [3, 50, 100_000])
def test_ids_are_the_tokenizer_s_whatever_is_remembered(monkeypatch, limit):
    monkeypatch.setattr(shards.PieceIds, "LIMIT", limit)
    pieces, rnd = shards.PieceIds(PATH), random.Random(3)
    for _ in range(12):
        texts = rnd.sample(ODD, 9) + [" ".join(f"w{rnd.randrange(90)}" for _ in range(rnd.randrange(40))) for _ in range(9)]
        rnd.shuffle(texts)
        keys = shards.keys_of_all(pa.array(texts, pa.string()))
        words = keys.flatten().dictionary_encode()
        ids = pieces.ids_of(pieces.numbers(words.dictionary)[words.indices.to_numpy()]).tolist()
        assert ids == [i for t in texts for i in pieces.sp.encode(t or "")]
        assert len(pieces.words) <= max(limit, limit // 2 + len(words.dictionary))


def test_a_full_table_keeps_the_words_that_recur(monkeypatch):
    monkeypatch.setattr(shards.PieceIds, "LIMIT", 400)
    pieces = shards.PieceIds(PATH)
    pieces.sp = Counted(sentencepiece.SentencePieceProcessor(model_file=PATH))
    common = [f"common{i}" for i in range(60)]
    for k in range(40):
        pieces.numbers(pa.array(common + [f"rare{k}x{i}" for i in range(100)]))
    assert len(pieces.sp.seen) == 60 + 40 * 100


def test_a_batch_of_odd_texts_as_sequences(spark):
    rows = [(i, t) for i, t in enumerate(ODD * 3)] + [(None, "no id")]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = shards.sequences(d, PATH, 16).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = [x for _, t in rows for x in [*sp.encode(t or ""), shards.END]]
    unpack = shards.Packer(b"").unpack
    got = b"".join(unpack(bytes(r.ids))[:2 * r.n_tokens] for r in out)
    assert got == b"".join(x.to_bytes(2, "little") for x in want)
    at = 0
    for i, t in rows:                       # every sequence that holds an id of a text names it
        end = at + len(sp.encode(t or "")) + 1
        assert all(i in out[k].doc_ids for k in range(at // 16, (end - 1) // 16 + 1))
        at = end


def test_the_sample_for_the_dictionary_starts_no_further_workers(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"a text {i} of some words " * 40) for i in range(300)] + [(None, None), (7, "")],
                              "doc_id long, text string")
    rows = lambda *a, **b: pytest.fail("rows are sent through Python workers")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", rows)
    assert len(shards.trained(d, PATH, 16)) > 0
    assert shards.trained(d.limit(0), PATH, 16) == b""
