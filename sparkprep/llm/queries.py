"""The registered queries of the training-data operators, with the DuckDB SQL
of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontaminate, licenses, lm, mixing, neardup, quality, repeats, search, shards, spelling,
               tokencount, toxicity)
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return d.withColumn("over_limit", F.col("n_tokens") > tokencount.LIMIT)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "item_id", "matched", "length")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("repeated"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op10_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.materialise(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(table(spark, sf_dir, "documents"))


def op12_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "item_id", "rank", "doc_id", "score")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    tokens = bpe.read_ranks(tokenizer("byte_bpe_multi_50k.tiktoken"))
    ids = bpe.encode(table(spark, sf_dir, "documents"), tokens, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(ids, tokens))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_mixing": op2_mixing,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_repeated_bytes": op7_repeated_bytes,
    "op8_lm_score": op8_lm_score,
    "op9_toxicity": op9_toxicity,
    "op10_training_shards": op10_training_shards,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_reversed_search": op12_reversed_search,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL = {
    "op1_license_scan": licenses.oracle(),
    "op2_mixing": mixing.ORACLE,
    "op12_reversed_search": search.ORACLE,
}
