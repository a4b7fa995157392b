"""End-to-end flows composed from the operators, each one lazy
plan apart from the small driver-side steps inside the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import templates as T
from ..operators.align import stage2_inputs
from ..operators.generate import ModelFactory, generate
from ..operators.lengths import pack
from ..operators.messages import build_messages, render
from ..operators.order import split_exact
from ..operators.pairs import fit_pair, template_pairs


def supervised_examples(records: DataFrame, task: str, block: int = 2048, key: str = "idx") -> DataFrame:
    """§3.1: records -> chat examples -> rendered text -> packed blocks."""
    m = build_messages(records, task, T.TRAIN, keep=(key,))
    return pack(m.select(key, render("messages").alias("text")), "text", [key], block)


def preference_sets(pairs: DataFrame, task: str, key: str = "pair_id", test_fraction: float = 0.02,
                    seed: int = 42, max_prompt: int = 1024, max_length: int = 1536) -> DataFrame:
    """§3.2: exact seeded split, templating (both splits in one pass), and the
    pair length budget. One table with a ``split`` column (write it with
    ``partitionBy("split")``)."""
    split = split_exact(pairs, key, test_fraction, seed)
    templated = template_pairs(split, task, keep=(key, "split"))
    return fit_pair(templated, max_prompt, max_length)


def two_stage_inference(records: DataFrame, stage1_task: str, stage2_task: str, make_model: ModelFactory,
                        k: int = 1, batch_size: int = 16, num_check: bool = False,
                        make_model2: ModelFactory | None = None, num_check1: bool = False,
                        batch_size2: int | None = None) -> DataFrame:
    """§3.3: stage-1 rationales (k per record), attached to the records by key
    (not by file position), then stage-2 outputs. Returns (idx, rep, rationale,
    text). ``make_model2`` and ``batch_size2`` are the second stage's (default: the
    first's); ``num_check1`` asks the first stage for one numeral, ``num_check`` the second."""
    if T.task_kind(stage1_task).stage != 1 or T.task_kind(stage2_task).stage != 2:
        raise ValueError("expected a stage-1 task and a stage-2 task")
    from ..session import shared_dir
    m1 = build_messages(records, stage1_task, T.INFER)
    s1 = generate(m1, make_model, k=k, batch_size=batch_size, num_check=num_check1).select("idx", "rep", "text")
    # Stage-1 outputs are used twice (stage-2 prompts and the returned
    # rationale); a sampling model must not run twice, so they are written
    # once to the shared folder (reliable checkpoint) and read from there.
    shared_dir(records.sparkSession)
    s1 = s1.checkpoint(eager=True)
    m2 = stage2_inputs(records, s1, stage2_task, k=k)
    s2 = generate(m2.withColumn("_key", F.col("idx") * k + F.col("rep")), make_model2 or make_model, k=1,
                  batch_size=batch_size2 or batch_size, num_check=num_check, key="_key")
    return (s2.select(F.expr(f"_key div {int(k)}").alias("idx"),
                      (F.col("_key") % k).cast("bigint").alias("rep"), "text")
            .join(s1.select("idx", F.col("rep").cast("bigint").alias("rep"), F.col("text").alias("rationale")),
                  ["idx", "rep"]))


def gap_pairs_templated(candidates: DataFrame, task: str, min_gap: float, key: str = "idx",
                        rep: str = "rep", ref: str = "ref", candidate: str = "candidate") -> DataFrame:
    """XP1 then PJ4: score every candidate against its reference text (ROUGE-1
    F), keep prompts whose best and worst candidates differ by ``min_gap``,
    and template the (news, chosen, rejected) pairs for the preference stage."""
    from ..operators.pairs import pairs_by_gap
    from ..operators.score import rouge1
    scored = rouge1(candidates, candidate, ref, [key, rep], keep=(candidate, ref))
    pairs = pairs_by_gap(scored, min_gap, key, rep, "f1", candidate, ref)
    return template_pairs(pairs, task, keep=(key, "chosen_rep", "rejected_rep"))
