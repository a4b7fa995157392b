"""Smaller API paths: custom prompt wording, merged JSON sink, record
conversion, and the errors raised for bad arguments."""

import json

import pytest
from pyspark.sql import functions as F

from sparkprep.operators import order as OR
from sparkprep.operators import templates as T
from sparkprep.operators.align import replicate
from sparkprep.operators.messages import build_messages
from sparkprep.operators.pairs import template_pairs
from sparkprep.operators.score import rouge1
from sparkprep.sources import files as S


def test_custom_system_texts(spark):
    df = spark.createDataFrame([(0, "n", "h")], "idx long, news string, headline string")
    texts = {k: f"custom {k[0]} {k[1]}" for k in T.SYSTEM_TEXTS}
    m = build_messages(df, "hg", T.INFER, system_texts=texts).first().messages
    assert m[0].content == "custom hg inference"
    pairs = spark.createDataFrame([(1, "n", "c", "r")], "pair_id int, news string, chosen string, rejected string")
    assert "custom hg train" in template_pairs(pairs, "hg", system_texts=texts).first().prompt


def test_write_merged_json_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}\nx") for i in range(30)], "idx long, text string")
    S.write_merged(df, str(tmp_path / "j"), "json")
    back = spark.read.json(str(tmp_path / "j")).orderBy("idx").collect()
    assert [r.text for r in back] == [f"t{i}\nx" for i in range(30)]
    S.write_merged(df, str(tmp_path / "t"), "txt")
    lines = S.read_lines(spark, str(tmp_path / "t")).orderBy("pos").collect()
    assert [r.text for r in lines] == [f"t{i} x" for i in range(30)]


def test_records_to_table(spark, tmp_path):
    recs = [{"news": f"n{i}", "headline": "h", "masked headline": "m", "ans": i, "summary": "s",
             "rationale_hg": "r", "rationale_cal": "c", "ecnc": "e"} for i in range(12)]
    (tmp_path / "r.json").write_text(json.dumps(recs))
    t = S.records_to_table(spark, str(tmp_path / "r.json"), str(tmp_path / "table"))
    assert sorted((r.idx, r.news, r.ans) for r in t.collect()) == [(i, f"n{i}", str(i)) for i in range(12)]


def test_bad_arguments(spark, tmp_path):
    df = spark.range(3).withColumnRenamed("id", "idx")
    with pytest.raises(ValueError):
        replicate(df, 0)
    with pytest.raises(ValueError):
        OR.assign_shard(df, 0)
    with pytest.raises(ValueError):
        S.write_outputs(df.withColumn("shard", F.lit(0)).withColumn("text", F.lit("x")), str(tmp_path / "o"), "csv")
    with pytest.raises(FileNotFoundError):
        (tmp_path / "empty").mkdir()
        S.read_rank_files(spark, str(tmp_path / "empty"), "json")
    pr = spark.createDataFrame([(0, "a", "b")], "pair_id long, hyp string, ref string")
    with pytest.raises(ValueError):
        rouge1(pr, method="other")
    with pytest.raises(ValueError):
        T.check_task("hg", "bogus-mode")
