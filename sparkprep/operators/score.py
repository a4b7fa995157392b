"""Scores: unigram-overlap F1 (AG3, JN4, SC14) and numeral accuracy (AG5)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem_column
from ..functions.text import numerals
from ..functions.tokens import overlap_tokens


def stemmed(tokens):
    """Array column of tokens -> array of their stems, inside the row."""
    return F.transform(tokens, lambda t: stem_column(t))


def _empty():
    return F.array().cast("array<string>")


def _scores(df: DataFrame, keys: list) -> DataFrame:
    p = F.col("overlap") / F.greatest(F.col("n_hyp"), F.lit(1))
    r = F.col("overlap") / F.greatest(F.col("n_ref"), F.lit(1))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return df.select(*keys, F.col("overlap").cast("bigint").alias("overlap"),
                     F.col("n_hyp").cast("bigint").alias("n_hyp"),
                     F.col("n_ref").cast("bigint").alias("n_ref"),
                     F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
                     F.round(f, 6).alias("f1"))


def sorted_overlap(h, r):
    """Multiset intersection size of two token arrays inside one row: sort
    both, then walk them together (equal: count and advance both; otherwise
    advance the smaller). Linear after the sorts, no shuffle. The sorted
    arrays are bound once as lambda variables so the walk reads them, not
    re-sorts them, at each step."""
    def walk(x):
        hs, rs = x["hs"], x["rs"]
        nh, nr = F.size(hs), F.size(rs)
        start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(0).cast("bigint").alias("o"))

        def step(acc, _):
            i, j, o = acc["i"], acc["j"], acc["o"]
            a, b = F.element_at(hs, i), F.element_at(rs, j)
            return (F.when((i > nh) | (j > nr), acc)
                    .when(a == b, F.struct((i + 1).alias("i"), (j + 1).alias("j"), (o + 1).alias("o")))
                    .when(a < b, F.struct((i + 1).alias("i"), j.alias("j"), o.alias("o")))
                    .otherwise(F.struct(i.alias("i"), (j + 1).alias("j"), o.alias("o"))))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(nh + nr, F.lit(1))), start, step, lambda acc: acc["o"])

    bound = F.array(F.struct(F.array_sort(h).alias("hs"), F.array_sort(r).alias("rs")))
    return F.element_at(F.transform(bound, walk), 1)


def rouge1(df: DataFrame, hyp: str = "hyp", ref: str = "ref", key: str = "pair_id",
           stem: bool = False, split_contractions: bool = True, method: str = "merge", keep=()) -> DataFrame:
    """AG3: ROUGE-1 precision, recall and F per row (``ref`` is the target).

    ``method="merge"`` scores each row inside the row: sorted token arrays
    walked together, no shuffle at all, whatever the text length; it can carry
    the columns ``keep`` along. ``method="aggregate"`` counts per (row, token)
    with a grouped aggregation (partial aggregation before the shuffle), then
    sums per row: no pairwise join of token lists, and a frequent token only
    meets its own row. Both give the same numbers; rows without tokens score 0.
    """
    if method not in ("merge", "aggregate"):
        raise ValueError("method must be 'merge' or 'aggregate'")
    if keep and method != "merge":
        raise ValueError("only method='merge' carries further columns")
    keys = [key] if isinstance(key, str) else list(key)
    tokens = lambda c: F.coalesce(overlap_tokens(c, split_contractions), _empty())
    toks = df.select(*keys, *keep, tokens(hyp).alias("_h"), tokens(ref).alias("_r"))
    if stem:
        toks = toks.withColumns({c: stemmed(F.col(c)) for c in ("_h", "_r")})
    if method == "aggregate":
        return _rouge_by_aggregation(toks, keys)
    counted = toks.select(*keys, *keep, sorted_overlap(F.col("_h"), F.col("_r")).alias("overlap"),
                          F.size("_h").alias("n_hyp"), F.size("_r").alias("n_ref"))
    return _scores(counted, [*keys, *keep])


def _rouge_by_aggregation(toks: DataFrame, keys: list) -> DataFrame:
    # explode_outer: a plain explode makes the optimizer infer a size(...) > 0
    # filter and evaluate the array expression a second time, and drops rows
    # without tokens
    sides = toks.select(*keys, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("_h").alias("toks")),
        F.struct(F.lit(1).alias("side"), F.col("_r").alias("toks")))).alias("_x"))
    toks = sides.select(*keys, F.col("_x.side").alias("side"), F.explode_outer("_x.toks").alias("tok"))
    present = F.col("tok").isNotNull()
    per_tok = toks.groupBy(*keys, "tok").agg(
        F.sum(F.when(present & (F.col("side") == 0), 1).otherwise(0)).alias("h"),
        F.sum(F.when(present & (F.col("side") == 1), 1).otherwise(0)).alias("r"))
    per_row = per_tok.groupBy(*keys).agg(F.sum(F.least("h", "r")).alias("overlap"),
                                       F.sum("h").alias("n_hyp"), F.sum("r").alias("n_ref"))
    return _scores(per_row, keys)


def number_correct(text, gt):
    """Exactly one numeral, and with commas removed it equals ``gt`` as text."""
    nums = numerals(text)
    return (F.size(nums) == 1) & (F.replace(F.element_at(nums, 1), F.lit(","), F.lit("")) == gt)


def number_accuracy(preds: DataFrame, gold: DataFrame, key: str = "idx", text: str = "text",
                    gt: str = "gt", num_type: str = "num_type") -> DataFrame:
    """AG5: accuracy per numeral type plus an overall row (num_type null).

    Predictions and gold are joined on the key (left join from gold: a missing
    prediction counts as wrong); the rollup keeps one partial aggregate per
    task before its small shuffle.
    """
    j = gold.join(preds.select(key, text), key, "left")
    ok = F.coalesce(number_correct(F.col(text), F.col(gt)), F.lit(False))
    return (j.rollup(num_type)
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.sum(ok.cast("int")).cast("bigint").alias("n_correct"))
            .withColumn("accuracy", F.round(F.col("n_correct") / F.col("n"), 6)))
