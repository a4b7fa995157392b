"""Token counts without token ids.

The tokenizer never merges across a border between a non-space and a space, so
a text is a sequence of pre-tokens (a run of spaces and the non-spaces after
it), and its count is the sum over distinct pre-tokens of frequency times the
pre-token's own count:

1. distinct pre-tokens of all texts, with their frequency (one aggregation);
2. each distinct pre-token is tokenized once; the counts are a written table;
3. the per-document frequencies are joined to the counts and summed. The
   most frequent pre-tokens (at most ``HEAD``, so a proven bound) are
   shipped to the tasks and summed while the text is read; the others, few in
   any natural corpus, go through an ordinary shuffle join.

Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and null ids are
counted row by row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, saved, shipped, sliced, text_bytes

HEAD = 200_000
LIMIT = 4096
# A space, or the character that the tokenizer itself writes for a space.
SPACE = " ▁"
PRE_TOKEN = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def pre_tokens(text: str) -> list[str]:
    """Pieces of the text as the tokenizer sees it: it puts one space in front."""
    return PRE_TOKEN.findall(" " + text) if text else []


def fast_pre_tokens(text: str) -> list[str]:
    """The same pieces; texts without double spaces are just split."""
    if not text:
        return []
    if "  " in text or "▁" in text or text[0] == " " or text[-1] == " ":
        return PRE_TOKEN.findall(" " + text)
    return [" " + w for w in text.split(" ")]


def piece_counter(path: str):
    """Counts pieces of pre-tokens with a sentencepiece model file that adds
    one space in front of its input and changes no characters."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(tokens: list[str]) -> list[int]:
        return [len(ids) for ids in encode_pieces(sp, tokens)]
    return count


def encode_pieces(sp, tokens: list[str]) -> list[list[int]]:
    """Ids of pre-tokens. The tokenizer adds the first space itself, but not
    to an empty input, so a lone space is looked up instead."""
    ids = sp.encode([t[1:] for t in tokens], num_threads=1)
    return [i or [sp.piece_to_id("▁")] for i in ids]


def check_model(path: str) -> None:
    """The split is exact only for models of this kind."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    inner = [p.piece for p in m.pieces if "▁" in p.piece.lstrip("▁")]
    if (m.trainer_spec.model_type != 2 or inner or n.precompiled_charsmap or n.remove_extra_whitespaces
            or not n.add_dummy_prefix or any(p.type == 4 for p in m.pieces)):
        raise ValueError("this model can merge across spaces or rewrites its input")


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """token, freq, n (pieces): one row per distinct pre-token of the corpus."""
    def distinct(batches):
        import pyarrow as pa
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                              names=["token", "freq"])
        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(fast_pre_tokens(t))
                if len(seen) >= 500_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    def tokenized(batches):
        import pyarrow as pa
        count = piece_counter(path)
        for b in batches:
            n = count(b.column("token").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("token"), b.column("freq"), pa.array(n, pa.int64())],
                                             names=["token", "freq", "n"])

    v = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(sliced(distinct), "token string, freq long")
         .groupBy("token").agg(F.sum("freq").alias("freq")))
    return saved(v.mapInArrow(tokenized, "token string, freq long, n long"), "token-vocabulary")


def most_frequent(vocab: DataFrame, most: int) -> DataFrame:
    """The rows above the lowest frequency that keeps them at ``most`` or fewer.
    The frequency is found from counts per frequency step (a few hundred rows),
    so nothing is sorted and the driver never sees more than it asked for."""
    step = F.floor(F.log2("freq") * 8).cast("int")
    left, lowest = most, None
    for r in vocab.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        left -= r.n
        if left < 0:
            break
        lowest = r.step
    return vocab.filter(step >= lowest) if lowest is not None else vocab.limit(0)


def token_counts(docs: DataFrame, path: str, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of ``docs``."""
    spark = docs.sparkSession
    shipped(spark)
    check_model(path)
    vocab = vocabulary(docs, path)
    top = most_frequent(vocab, head).select("token", "n").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top["token"].to_pylist(), top["n"].to_pylist())))

    def run(batches):
        import pyarrow as pa
        n_of = known.value
        for b in batches:
            n_bytes, sums, rest, freq = [], [], [], []
            for t, raw in zip(b.column("text").to_pylist(), text_bytes(b.column("text"))):
                total, others = 0, Counter()
                for token, f in Counter(fast_pre_tokens(t)).items():
                    n = n_of.get(token)
                    if n is None:
                        others[token] = f
                    else:
                        total += f * n
                n_bytes.append(len(raw or b""))
                sums.append(total)
                rest.append(list(others))
                freq.append(list(others.values()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(sums, pa.int64()),
                 pa.array(rest, pa.list_(pa.string())), pa.array(freq, pa.list_(pa.int64()))],
                names=["doc_id", "n_bytes", "head", "rest", "freq"])

    rows = id_text(docs).mapInArrow(
        sliced(run), "doc_id long, n_bytes long, head long, rest array<string>, freq array<long>")
    # written once: rows get a number that stays the same however often they are read
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "token-frequencies")
    tail = (rows.filter(F.size("rest") > 0)
            .select("row", F.explode(F.arrays_zip("rest", "freq")).alias("x"))
            .select("row", F.col("x.rest").alias("token"), F.col("x.freq").alias("f"))
            .join(vocab.select("token", "n"), "token")
            .groupBy("row").agg(F.sum(F.col("f") * F.col("n")).alias("tail")))
    return rows.join(tail, "row", "left").select(
        "doc_id", "n_bytes", (F.col("head") + F.coalesce("tail", F.lit(0))).alias("n_tokens"))
