import pytest
from pyspark.sql import functions as F

from sparkprep.operators import generate as G
from sparkprep.operators import templates as T
from sparkprep.operators.align import replicate, stage2_inputs, zip_join
from sparkprep.operators.messages import build_messages


def test_replicate_count_and_pos(spark):
    df = spark.range(10).withColumnRenamed("id", "idx")
    r = replicate(df, 3).collect()
    assert len(r) == 30 and sorted(x.pos for x in r) == list(range(30))


def test_zip_truncates_and_strict(spark):
    a = spark.range(5).withColumnRenamed("id", "idx")
    b = spark.range(3).withColumnRenamed("id", "idx").withColumn("t", F.lit("x"))
    assert zip_join(a, b).count() == 3
    with pytest.raises(ValueError):
        zip_join(a, b, strict=True)


def test_stage2_positional_with_k(spark):
    ex = spark.createDataFrame([(i, f"n{i}", f"h{i}") for i in range(3)], "idx long, news string, headline string")
    outs = spark.createDataFrame([(p, f"r{p}") for p in range(6)], "pos long, text string")
    m = stage2_inputs(ex, outs, "rationale_hg_stg2_emp", k=2).collect()
    got = {(r.idx, r.rep): r.messages[1].content for r in m}
    assert got[(1, 1)] == "news: n1 r3" and got[(2, 0)] == "news: n2 r4" and len(got) == 6


def _attempts(spark, rows):
    return spark.createDataFrame(rows, "idx long, attempt long, text string")


def test_select_attempt_cases(spark):
    rows = []
    rows += [(1, a, "got 5" if a == 0 else "x") for a in range(21)]           # ok first
    rows += [(2, a, "got 7" if a >= 7 else "1 and 2") for a in range(25)]       # ok at 7th
    rows += [(3, a, f"no {a} {a}") for a in range(25)]                          # never: last <= 20
    rows += [(4, 0, "just words")]                                              # one attempt
    got = {r.idx: (r.attempt, r.text) for r in G.select_attempt(_attempts(spark, rows)).collect()}
    assert got == {1: (0, "got 5"), 2: (7, "got 7"), 3: (20, "no 20 20"), 4: (0, "just words")}
    off = {r.idx: r.attempt for r in G.select_attempt(_attempts(spark, rows), num_check=False).collect()}
    assert off == {1: 0, 2: 0, 3: 0, 4: 0}


def test_generate_with_retry(spark):
    ex = spark.createDataFrame([(i, "x" * i, "h") for i in range(1, 30)], "idx long, news string, headline string")
    m = build_messages(ex, "hg", T.INFER)
    out = G.generate(m, G.echo_model, num_check=True, batch_size=4).collect()
    for r in out:
        n = len(r.prompt)
        if n % 7:
            assert (r.attempts, r.text) == (n % 4, f"answer {n + n % 4}")
        else:
            assert (r.attempts, r.text) == (20, f"answer {n} and 20")


def test_generate_partitions(spark):
    ex = spark.createDataFrame([(i, "x" * i, "h") for i in range(1, 40)], "idx long, news string, headline string")
    m = build_messages(ex, "hg", T.INFER)
    out = G.generate(m, G.echo_model, k=2, partitions=3)
    assert out.rdd.getNumPartitions() == 3 and out.count() == 78


def counting(log, dies_at=None):
    """Factory of an echo model that notes every prompt it is given, and dies at its n-th call."""
    def make():
        from sparkprep.operators.generate import EchoModel
        calls = []

        def model(prompts, attempt=0):
            calls.append(attempt)
            if len(calls) == dies_at:
                raise RuntimeError("killed")
            with open(log, "a") as f:
                f.writelines(f"{attempt} {len(p)}\n" for p in prompts)
            return EchoModel()(prompts, attempt)
        return model
    return make


@pytest.mark.parametrize("num_check", [False, True])
def test_killed_generation_resumes(spark, tmp_path, num_check):
    """One task, killed at its 12th model call: no prompt is generated twice, none is missing."""
    ex = spark.createDataFrame([(i, "x" * i, "h") for i in range(1, 120)], "idx long, news string, headline string").coalesce(1)
    m = build_messages(ex, "hg", T.INFER)
    log, path = str(tmp_path / "log"), str(tmp_path / "out")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        with pytest.raises(Exception, match="killed"):
            G.generate_resumable(m, counting(log, 12), path, batch_size=5, num_check=num_check)
        first = len(open(log).readlines())
        assert 0 < first
        out = G.generate_resumable(m, counting(log), path, batch_size=5, num_check=num_check)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = {(r.idx, r.rep): (r.text, r.attempts) for r in out.collect()}
    want = {(r.idx, r.rep): (r.text, r.attempts) for r in G.generate(m, G.echo_model, num_check=num_check, batch_size=5).collect()}
    assert got == want and out.count() == 119
    asked = open(log).read().split("\n")[:-1]
    if not num_check:       # every prompt has a length of its own
        assert len(asked) == len(set(asked)) == 119
    again = len(asked)
    assert G.generate_resumable(m, counting(log), path, batch_size=5, num_check=num_check).count() == 119
    assert len(open(log).readlines()) == again
    with pytest.raises(ValueError, match="another input"):
        G.generate_resumable(m.limit(5), G.echo_model, path, batch_size=5)


def test_killed_generation_in_many_tasks_loses_and_repeats_nothing_finished(spark, tmp_path):
    ex = spark.createDataFrame([(i, "x" * i, "h") for i in range(1, 200)], "idx long, news string, headline string").repartition(4)
    m = build_messages(ex, "hg", T.INFER)
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="killed"):
        G.generate_resumable(m, counting(str(tmp_path / "log"), 6), path, k=2, batch_size=3)
    out = G.generate_resumable(m, G.echo_model, path, k=2, batch_size=3)
    rows = [(r.idx, r.rep, r.text) for r in out.collect()]
    assert len(rows) == len(set(rows)) == 398
    assert sorted(rows) == sorted((r.idx, r.rep, r.text) for r in G.generate(m, G.echo_model, k=2).collect())


def test_stages_have_their_own_settings(spark):
    from sparkprep.plans.flows import two_stage_inference
    recs = spark.createDataFrame([(i, "n" * i, "h", "m", "1", "s", "r", "c", "e") for i in range(1, 20)],
                                 "idx long, news string, headline string, masked_headline string, ans string, summary string, "
                                 "rationale_hg string, rationale_cal string, ecnc string")
    free = two_stage_inference(recs, "rationale_hg_stg1_ecnc", "rationale_hg_stg2_ecnc", G.echo_model).collect()
    held = two_stage_inference(recs, "rationale_hg_stg1_ecnc", "rationale_hg_stg2_ecnc", G.echo_model, num_check1=True,
                               batch_size2=3).collect()
    assert sum(" and " in r.rationale for r in held) < sum(" and " in r.rationale for r in free)


def test_generation_takes_few_rows_at_a_time_in_whole_model_batches(spark, tmp_path):
    log = str(tmp_path / "log")

    def make():
        def model(prompts, attempt=0):
            with open(log, "a") as f:
                f.write(f"{len(prompts)}\n")
            return [p + " answer 1" for p in prompts]
        return model
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(rows, "10000")
    spark.conf.set(size, "64m")
    ex = spark.range(0, 2600, 1, 1).selectExpr("id AS idx", "repeat('n', 50) AS news", "'h' AS headline")
    out = G.generate(build_messages(ex, "hg", T.INFER), make, k=1, batch_size=1300)
    assert int(spark.conf.get(rows)) == 1000 and int(spark.conf.get(size)) == 4 << 20
    got = out.select("idx", "text").collect()
    assert sorted(r.idx for r in got) == list(range(2600)) and {r.text for r in got} == {"answer 1"}
    assert open(log).read().split() == ["1300", "1300"]
