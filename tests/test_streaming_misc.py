from pyspark.sql import functions as F

from sparkprep.operators import order as OR
from sparkprep.operators import templates as T
from sparkprep.operators.messages import build_messages, render, prompt_messages
from sparkprep.session import scratch_path, shared_dir
from sparkprep.streaming.rows import stream_through


def test_stream_runs_row_local_operators(spark, tmp_path):
    src = tmp_path / "src"
    rows = [(i, f"news {i}. more", f"Head {i}") for i in range(50)]
    spark.createDataFrame(rows, "idx long, news string, headline string").repartition(3).write.parquet(str(src))

    def transform(df):
        m = build_messages(df, "hg", T.INFER)
        return m.select("idx", render(prompt_messages("messages"), True).alias("prompt"))

    schema = spark.read.parquet(str(src)).schema
    sink = stream_through(spark, str(src), schema, transform, max_files_per_trigger=1)
    streamed = {r.idx: r.prompt for r in spark.read.parquet(sink).collect()}
    batch = {r.idx: r.prompt for r in transform(spark.read.parquet(str(src))).collect()}
    assert streamed == batch and len(streamed) == 50


def test_position_with_null_groups(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(60)], "id long, g int")
    got = {r.id: r.pos for r in OR.with_position(df, ["id"], partition_by=["g"], partitions=5).collect()}
    for g in (None, 0, 1):
        ids = sorted(i for i in range(60) if (None if i % 3 == 0 else i % 2) == g)
        assert [got[i] for i in ids] == list(range(len(ids)))


def test_route_column(spark):
    df = spark.createDataFrame([(t,) for t in T.TASKS], "task string")
    got = {r.task: (r.stage, r.output_format, r.rationale_column) for r in T.route(df).collect()}
    for t in T.TASKS:
        k = T.task_kind(t)
        assert got[t] == (k.stage, k.output_format, k.rationale_column)


def test_shared_dir_is_the_sessions(spark):
    d = shared_dir(spark)
    assert d and scratch_path(spark, "x").startswith(d.rstrip("/") + "/x-")
