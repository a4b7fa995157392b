"""Preference pairs: templating (PJ4/PJ5), the pair length budget (TR2) and
pairs chosen by score gap (XP1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import to_text
from ..functions.tokens import WORDS
from . import templates as T
from .messages import IM_END, message, render

# Tasks with a preference-stage system text.
PAIR_TASKS = ("rationale_hg_stg1_ecnc", "hg")


def template_pairs(df: DataFrame, task: str, eos: str = IM_END, keep=("pair_id",),
                   system_texts: dict | None = None) -> DataFrame:
    """PJ4 + PJ5: prompt = render([system]) + render([user "news: " + str(news)],
    generation prompt); chosen/rejected get eos + newline; news is dropped.
    ``news`` is not stripped here."""
    if task not in PAIR_TASKS:
        raise ValueError(f"no preference template for task {task!r}; expected one of {PAIR_TASKS}")
    texts = system_texts or T.SYSTEM_TEXTS
    system = render(F.array(message("system", F.lit(texts[(task, T.TRAIN)]))))
    user = render(F.array(message("user", F.concat(F.lit("news: "), to_text("news")))),
                  add_generation_prompt=True)
    suffix = F.lit(eos + "\n")
    return df.select(*keep,
                     F.concat(system, user).alias("prompt"),
                     F.concat(to_text("chosen"), suffix).alias("chosen"),
                     F.concat(to_text("rejected"), suffix).alias("rejected"))


def fit_pair(df: DataFrame, max_prompt: int = 1024, max_length: int = 1536,
             prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected",
             tokens=WORDS) -> DataFrame:
    """TR2: if prompt + longer response exceeds ``max_length`` keep the last
    ``max_prompt`` prompt tokens; if still over, keep the first
    ``max_length - max_prompt`` tokens of each response. Adds the token counts.
    A cut prompt is a suffix and a cut response a prefix of its text, byte for
    byte; every other text stays as it is. ``tokens``: words, or a ``TokenHook``."""
    keep_n = max_length - max_prompt
    tmp = df.withColumns({"_p": tokens.count(prompt), "_c": tokens.count(chosen), "_r": tokens.count(rejected)})
    longer = F.greatest("_c", "_r")
    over = F.col("_p") + longer > F.lit(max_length)
    fitted = F.when(over, F.least(F.col("_p"), F.lit(max_prompt))).otherwise(F.col("_p"))
    still = fitted + longer > F.lit(max_length)
    count = lambda n: F.when(still, F.least(F.col(n), F.lit(keep_n))).otherwise(F.col(n)).cast("bigint")
    text = lambda c, n: F.when(still & (F.col(n) > keep_n), tokens.first(c, keep_n)).otherwise(F.col(c))
    return tmp.withColumns({
        prompt: F.when(over & (F.col("_p") > max_prompt), tokens.last(prompt, max_prompt)).otherwise(F.col(prompt)),
        chosen: text(chosen, "_c"), rejected: text(rejected, "_r"),
        "prompt_tokens": fitted.cast("bigint"), "chosen_tokens": count("_c"), "rejected_tokens": count("_r"),
    }).drop("_p", "_c", "_r")


def pairs_by_gap(scored: DataFrame, min_gap: float, key: str = "idx", rep: str = "rep",
                 score: str = "score", text: str = "candidate", prompt: str | None = "ref") -> DataFrame:
    """XP1: per prompt, best-scoring candidate = chosen, worst = rejected; keep
    prompts whose best - worst >= ``min_gap``. Ties go to the lowest ``rep``.

    One aggregation keyed by prompt (partial aggregation first, so a prompt
    with very many candidates does not land whole in one task).
    """
    best = F.max(F.struct(F.col(score), (-F.col(rep)).alias("neg_rep"), F.col(text).alias("t")))
    worst = F.min(F.struct(F.col(score), F.col(rep).alias("r"), F.col(text).alias("t")))
    aggs = [best.alias("_best"), worst.alias("_worst"), F.count(F.lit(1)).alias("n_candidates")]
    if prompt:
        aggs.append(F.first(prompt).alias("_prompt"))
    g = scored.groupBy(key).agg(*aggs)
    out = g.select(
        key,
        *( [F.col("_prompt").alias("news")] if prompt else []),
        F.col("_best.t").alias("chosen"), F.col("_worst.t").alias("rejected"),
        (-F.col("_best.neg_rep")).alias("chosen_rep"), F.col("_worst.r").alias("rejected_rep"),
        F.col("_best").getField(score).alias("chosen_score"),
        F.col("_worst").getField(score).alias("rejected_score"),
        F.col("n_candidates").cast("bigint").alias("n_candidates"))
    gap: Column = F.col("chosen_score") - F.col("rejected_score")
    return out.where(gap >= F.lit(min_gap))
