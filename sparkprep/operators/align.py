"""Replication and key alignment (GN1, GN2, JN1, JN3).

List position in the reference becomes an explicit key: every side carries
``idx`` (and ``rep`` when replicated), and alignment is an equi-join on it.
The join strategy is left to the planner: a side whose measured size is under
the broadcast threshold is broadcast (AQE re-plans from runtime sizes),
anything larger is a sort-merge join on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import templates as T
from .messages import build_messages


def replicate(df: DataFrame, k: int, key: str = "idx", rep: str = "rep", pos: str = "pos") -> DataFrame:
    """GN1/GN2: every row k times, sample-major; pos = key * k + rep."""
    if k is None or k < 1:
        raise ValueError("k must be a positive integer")
    out = df.withColumn(rep, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return out.withColumn(pos, F.col(key).cast("bigint") * k + F.col(rep))


def zip_join(left: DataFrame, right: DataFrame, key: str = "idx", strict: bool = False,
             how: str = "inner") -> DataFrame:
    """JN1: row i of ``left`` gets row i of ``right`` (both keyed by position).

    Like zip, the result has as many rows as the shorter side. With
    ``strict=True`` differing row counts raise instead.
    """
    if strict:
        nl, nr = left.count(), right.count()
        if nl != nr:
            raise ValueError(f"positional join: left has {nl} rows, right has {nr}")
    return left.join(right, key, how)


def stage2_inputs(examples: DataFrame, outputs: DataFrame, task: str, k: int | None = None,
                  text: str = "text", strict: bool = False, keep=("idx",)) -> DataFrame:
    """JN3: stage-1 outputs attached to the records, then stage-2 messages.

    ``outputs`` is either positional (``pos``, text) -- the flattened,
    sample-major list of k generations per record -- or keyed by
    (``idx``[, ``rep``]). With k set, records are replicated k times (GN2) so
    both sides always agree on the layout.
    """
    kind = T.task_kind(task)
    if kind.stage != 2:
        return build_messages(examples, task, T.INFER, keep=keep)
    rcol = kind.rationale_column
    if k:
        left = replicate(examples, k)
        if "pos" in outputs.columns:
            right = outputs.select("pos", F.col(text).alias(rcol))
            joined = zip_join(left, right, "pos", strict)
        else:
            right = outputs.select("idx", "rep", F.col(text).alias(rcol))
            joined = left.join(right, ["idx", "rep"])
        keep = tuple(keep) + ("rep",)
    else:
        key = "pos" if "pos" in outputs.columns else "idx"
        right = outputs.select(F.col(key).alias("idx"), F.col(text).alias(rcol))
        joined = zip_join(examples, right, "idx", strict)
    return build_messages(joined, task, T.INFER, keep=keep)
