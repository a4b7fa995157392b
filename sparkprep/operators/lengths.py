"""Length measures and token-level cuts (AG1, AG2, TR1, WN3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import WORDS, concat_token_count, token_count
from .ranges import running_total, written


def length_profile(df: DataFrame, messages: str = "messages", counter=token_count) -> DataFrame:
    """AG1: maximum token count of the system, user and assistant contents,
    all three in one pass."""
    m = F.col(messages)
    return df.agg(*[F.max(counter(F.element_at(m, i)["content"])).cast("bigint").alias(f"max_{r}_tokens")
                    for i, r in ((1, "system"), (2, "user"), (3, "assistant"))])


def pair_length_profile(df: DataFrame, counter=token_count) -> DataFrame:
    """AG2: max prompt tokens, and the max over prompt+chosen and
    prompt+rejected (texts concatenated first, then counted), in one pass."""
    if counter is token_count:
        # each text is tokenized once; concatenations are counted exactly
        # from the parts (a token may fuse across the joint)
        counted = df.select("prompt", "chosen", "rejected", token_count("prompt").alias("_p"),
                            token_count("chosen").alias("_c"), token_count("rejected").alias("_r"))
        p = F.col("_p")
        pc = concat_token_count("prompt", "chosen", p, F.col("_c"))
        pr = concat_token_count("prompt", "rejected", p, F.col("_r"))
        df = counted
    else:
        p = counter("prompt")
        pc = counter(F.concat("prompt", "chosen"))
        pr = counter(F.concat("prompt", "rejected"))
    return df.agg(F.max(p).cast("bigint").alias("max_prompt_tokens"),
                  F.greatest(F.max(pc), F.max(pr)).cast("bigint").alias("max_pair_tokens"))


def truncate_left(c, n: int, tokens=WORDS):
    """TR1: keep the last ``n`` tokens. The result is a suffix of the text, from the
    start of its n-th last token on; a text of at most ``n`` tokens stays whole.
    ``tokens`` counts and cuts: words, or a ``TokenHook``."""
    return tokens.last(c, n)


def pack(df: DataFrame, text: str = "text", order_by=("idx",), block: int = 2048,
         keep_partial: bool = False, tokens=WORDS) -> DataFrame:
    """WN3: concatenate the token sequences of all rows in ``order_by`` order
    and cut the stream into blocks of ``block`` tokens, no separator token.
    The last, partial block is dropped unless ``keep_partial``. ``order_by`` may be
    any orderable columns, null first; rows that tie come in one arbitrary order.
    ``tokens`` gives the array: words by default, ids with a ``TokenHook``. Null and empty texts add nothing.

    Each row's start offset in the stream is a running sum over ranges of equal
    share; a row is then exploded into the blocks it touches, and each block is
    gathered by an aggregation whose groups hold at most ``block`` tokens.
    """
    order = list(order_by)
    # the tokens are made and written once; boundaries and totals read the keys
    # and the counts only, and each row's tokens are cut where its range is sorted
    made = df.select(*order, tokens.array(text).alias("_tokens")).withColumn("_n", F.size("_tokens"))
    rows = running_total(written(made, "pack").where(F.col("_n") > 0), [F.col(c) for c in order], F.col("_n"), "_s")
    first = F.floor(F.col("_s") / block).cast("bigint")
    last = F.floor((F.col("_s") + F.col("_n") - 1) / block).cast("bigint")
    s, n = F.col("_s"), F.col("_n")

    def pieces_of(t):
        def piece(b):
            lo = F.greatest(b * block, s)
            hi = F.least((b + 1) * block, s + n)
            return F.struct(b.alias("block_id"),
                            F.slice(t, (lo - s + 1).cast("int"), (hi - lo).cast("int")).alias("_piece"))
        return F.transform(F.sequence(first, last), piece)

    # only the pieces are exploded: the whole array is never copied per piece
    cut = rows.select("_s", pieces_of(F.col("_tokens")).alias("_pieces"))
    pieces = cut.select("_s", F.inline_outer("_pieces")).where(F.col("block_id").isNotNull())
    blocks = (pieces.groupBy("block_id")
              .agg(F.collect_list(F.struct("_s", "_piece")).alias("_parts"),
                   F.sum(F.size("_piece")).cast("bigint").alias("n_tokens")))
    if not keep_partial:
        blocks = blocks.where(F.col("n_tokens") == block)
    return blocks.select("block_id", "n_tokens",
                         F.flatten(F.transform(F.array_sort("_parts"), lambda x: x["_piece"])).alias("tokens"))
