"""The README usage flow, end to end on small files with the stand-in model."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from sparkprep.operators import templates as T
from sparkprep.operators.align import stage2_inputs
from sparkprep.operators.generate import echo_model, generate, preview_generate
from sparkprep.operators.lengths import length_profile, pair_length_profile
from sparkprep.operators.messages import build_messages
from sparkprep.operators.score import number_accuracy, rouge1
from sparkprep.plans.flows import preference_sets, supervised_examples
from sparkprep.sources import files as S


def test_readme_flow(spark, tmp_path):
    recs = [{"news": f"Story {i} about {i * 3} people.", "headline": f"{i * 3} people", "masked headline": "____ people",
             "ans": i * 3, "summary": "s", "rationale_hg": "r", "rationale_cal": "c", "ecnc": f"count {i * 3}"}
            for i in range(30)]
    (tmp_path / "train.json").write_text(json.dumps(recs))
    records = S.records_to_table(spark, str(tmp_path / "train.json"), str(tmp_path / "records"))
    sft = build_messages(records, "rationale_hg_stg1_ecnc")
    assert supervised_examples(records, "rationale_hg_stg1_ecnc", 64).count() > 0
    assert length_profile(sft).first().max_assistant_tokens == 2

    d = tmp_path / "pairs.hf"
    d.mkdir()
    t = pa.table({"news": [f"n{i}" for i in range(50)], "chosen": ["good"] * 50, "rejected": ["bad"] * 50})
    with pa.OSFile(str(d / "data-00000-of-00001.arrow"), "wb") as sink, pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    (d / "state.json").write_text(json.dumps({"_data_files": [{"filename": "data-00000-of-00001.arrow"}]}))
    pairs = S.read_pairs(spark, str(d))
    S.write_split(preference_sets(pairs, "rationale_hg_stg1_ecnc", key="idx"), str(tmp_path / "pref"))
    train = S.read_split(spark, str(tmp_path / "pref"), "train")
    assert train.count() == 49 and pair_length_profile(train).first().max_prompt_tokens > 0

    stage1 = generate(build_messages(records, "rationale_hg_stg1_ecnc", T.INFER), echo_model)
    S.write_outputs(stage1.withColumn("shard", F.lit(0)), str(tmp_path / "stage1"), "json")
    assert preview_generate(build_messages(records, "hg", T.INFER), echo_model, 1).count() == 1
    m2 = stage2_inputs(records, S.read_outputs(spark, str(tmp_path / "stage1"), "json"), "rationale_hg_stg2_ecnc")
    stage2 = generate(m2, echo_model, num_check=True)
    assert stage2.count() == 30

    (tmp_path / "gt.txt").write_text("\n".join(str(i * 3) for i in range(30)))
    (tmp_path / "type.txt").write_text("\n".join(str(i % 2) for i in range(30)))
    acc = {r.num_type: r.n for r in number_accuracy(stage2, S.read_gold(spark, str(tmp_path / "gt.txt"),
                                                                          str(tmp_path / "type.txt"))).collect()}
    assert acc == {0: 15, 1: 15, None: 30}
    hr = records.select(F.col("idx").alias("pair_id"), F.col("headline").alias("hyp"), F.col("headline").alias("ref"))
    assert {r.f1 for r in rouge1(hr, stem=True).collect()} == {1.0}
