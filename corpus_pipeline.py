"""The corpus pipeline: documents in, training-order shards out.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept
and returns a DataFrame; all but the last return the columns of documents.
``run`` writes every stage's result as Parquet in the shared folder and reads it
back as the next one's input, so a lost executor costs a re-read, not a re-run.

Nulls, empty tables, repeated rows and further columns: see the operators; no
stage drops a row for any of these alone (repeated rows are near copies of each
other, of which one stays).
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkprep.llm import decontaminate, mixing, neardup, shards, toxicity  # noqa: E402
from sparkprep.llm.common import saved, table  # noqa: E402
from sparkprep.llm.queries import tokenizer  # noqa: E402


SIMILAR = 80                # percent at which texts are near copies


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs, SIMILAR)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def write_training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shards.materialise(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_per_group),
    ("decontamination", reject_contaminated),
    ("mixing", mix_sources),
    ("training_shards", write_training_order),
]

# Learned scores, minhashes and token ids are beyond SQL; tests hold the stages and
# the run against brute force over a small table instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
