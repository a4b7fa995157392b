import pytest
import json
import os

import pyarrow as pa

from sparkprep.sources import files as S


def test_read_records(spark, tmp_path):
    recs = [{"news": " a ", "headline": "h", "masked headline": "m", "ans": 3, "summary": None,
             "rationale_hg": "r", "rationale_cal": "c", "ecnc": True},
            {"news": "b", "headline": "h2", "masked headline": "m2", "ans": 2.5, "summary": "s",
             "rationale_hg": "r", "rationale_cal": "c", "ecnc": False},
            {"news": "c", "headline": "h3", "masked headline": "m3", "ans": 10000000000.0, "summary": "s",
             "rationale_hg": "r", "rationale_cal": "c", "ecnc": None}]
    p = tmp_path / "records.json"
    p.write_text(json.dumps(recs))
    rows = S.read_records(spark, str(p)).orderBy("idx").collect()
    assert [r.idx for r in rows] == [0, 1, 2]
    assert [r.ans for r in rows] == ["3", "2.5", "10000000000.0"]       # str() forms kept
    assert [r.ecnc for r in rows] == ["True", "False", None]
    assert rows[0].masked_headline == "m" and rows[0].summary is None


def test_read_string_list(spark, tmp_path):
    p = tmp_path / "strings.json"
    p.write_text(json.dumps(["x\ny", "", "z"]))
    got = [(r.pos, r.text) for r in S.read_string_list(spark, str(p)).orderBy("pos").collect()]
    assert got == [(0, "x\ny"), (1, ""), (2, "z")]


def test_read_lines_like_python(spark, tmp_path):
    p = tmp_path / "lines.txt"
    p.write_text("  first \nsec\rthird\n\n last\n")
    got = [r.text for r in S.read_lines(spark, str(p)).orderBy("pos").collect()]
    with open(p) as f:
        assert got == [line.strip() for line in f]


def test_rank_files_merge(spark, tmp_path):
    d = tmp_path / "out"
    d.mkdir()
    json.dump(["a0", "a1"], open(d / "rank-0.json", "w"))
    json.dump(["b0"], open(d / "rank-1.json", "w"))
    json.dump([], open(d / "rank-2.json", "w"))
    json.dump(["c0", "c1\nx"], open(d / "rank-10.json", "w"))
    json.dump(["zzz"], open(d / "rank-c.json", "w"))
    got = [r.text for r in S.read_rank_files(spark, str(d), "json").orderBy("idx").collect()]
    assert got == ["a0", "a1", "b0", "c0", "c1\nx"]
    (d / "rank-0.txt").write_text("l0\nl1")
    (d / "rank-1.txt").write_text(" l2 \nl3\n")
    got = [r.text for r in S.read_rank_files(spark, str(d), "txt").orderBy("idx").collect()]
    assert got == ["l0", "l1", "l2", "l3"]


def test_write_read_outputs_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(i, i // 4, f"out {i}\nline") for i in range(20)], "idx long, shard int, text string")
    S.write_outputs(df, str(tmp_path / "j"), "json")
    back = {r.idx: (r.shard, r.text) for r in S.read_outputs(spark, str(tmp_path / "j"), "json").collect()}
    assert back == {i: (i // 4, f"out {i}\nline") for i in range(20)}
    S.write_outputs(df, str(tmp_path / "t"), "txt")
    back = {r.idx: r.text for r in S.read_outputs(spark, str(tmp_path / "t"), "txt").collect()}
    assert back == {i: f"out {i} line" for i in range(20)}


def test_read_pairs_arrow_dataset(spark, tmp_path):
    d = tmp_path / "pairs.hf"
    d.mkdir()
    files = []
    for s in range(2):
        t = pa.table({"news": [f"n{s}{i}" for i in range(3)], "chosen": ["c"] * 3, "rejected": ["r"] * 3})
        fn = f"data-0000{s}-of-00002.arrow"
        with pa.OSFile(str(d / fn), "wb") as sink, pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        files.append({"filename": fn})
    (d / "state.json").write_text(json.dumps({"_data_files": files}))
    got = [(r.idx, r.news) for r in S.read_pairs(spark, str(d)).orderBy("idx").collect()]
    assert got == [(0, "n00"), (1, "n01"), (2, "n02"), (3, "n10"), (4, "n11"), (5, "n12")]


def test_read_lines_across_many_splits(spark, tmp_path):
    p = tmp_path / "big.txt"
    lines = [f" line {i} " + "x" * (i % 50) for i in range(60000)]
    p.write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024))
    try:
        df = S.read_lines(spark, str(p))
        assert df.rdd.getNumPartitions() > 10
        got = {r.pos: r.text for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: l.strip() for i, l in enumerate(lines)}


def test_read_gold_checks_lengths(spark, tmp_path):
    import pytest
    (tmp_path / "gt.txt").write_text("007\n12\n3")
    (tmp_path / "type.txt").write_text("1\n0\n0\n1\n0\n")
    with pytest.raises(ValueError):
        S.read_gold(spark, str(tmp_path / "gt.txt"), str(tmp_path / "type.txt"))
    got = sorted(tuple(r) for r in S.read_gold(spark, str(tmp_path / "gt.txt"), str(tmp_path / "type.txt"),
                                                strict=False).collect())
    assert got == [(0, "007", 1), (1, "12", 0), (2, "3", 0)]


def test_split_container_prunes(spark, tmp_path):
    from sparkprep.operators.order import split_exact
    df = spark.range(200).withColumnRenamed("id", "pair_id")
    S.write_split(split_exact(df, "pair_id", 0.1), str(tmp_path / "sets"))
    test = S.read_split(spark, str(tmp_path / "sets"), "test")
    assert test.count() == 20
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "(split" in plan


def test_stage2_from_files(spark, tmp_path):
    """Record array + stage-1 sidecar (JSON array, 2 generations per record,
    one short) -> stage-2 inference messages keyed by (idx, rep)."""
    from sparkprep.operators.align import stage2_inputs
    from sparkprep.operators.messages import explode_messages
    recs = [{"news": f" n{i} ", "headline": f"h{i}", "masked headline": "m", "ans": i, "summary": "s",
             "rationale_hg": "r", "rationale_cal": "c", "ecnc": "e"} for i in range(4)]
    (tmp_path / "records.json").write_text(json.dumps(recs))
    (tmp_path / "rank-c.json").write_text(json.dumps([f" gen{p} " for p in range(7)]))
    ex = S.read_records(spark, str(tmp_path / "records.json"))
    side = S.read_string_list(spark, str(tmp_path / "rank-c.json"))
    m = explode_messages(stage2_inputs(ex, side, "rationale_hg_stg2_ecnc", k=2), keep=("idx", "rep"))
    users = {(r.idx, r.rep): r.content for r in m.where("role = 'user'").collect()}
    assert users == {(p // 2, p % 2): f"news: n{p // 2}\n\ngen{p}" for p in range(7)}


def test_select_shard_prunes_files(spark, tmp_path):
    from sparkprep.operators.order import select_shard
    df = spark.createDataFrame([(i, i // 10, f"t{i}") for i in range(40)], "idx long, shard int, text string")
    S.write_outputs(df, str(tmp_path / "out"), "json")
    one = select_shard(S.read_outputs(spark, str(tmp_path / "out"), "json"), 2)
    assert sorted(r.idx for r in one.collect()) == list(range(20, 30))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan


def test_corrupt_and_missing_inputs_fail(spark, tmp_path):
    from sparkprep.sources import files as S
    (tmp_path / "bad.json").write_text('["a", "b')
    with pytest.raises(Exception, match="JSON array"):
        S.read_string_list(spark, str(tmp_path / "bad.json")).collect()
    ranks = tmp_path / "ranks"
    ranks.mkdir()
    for i in (0, 2):
        (ranks / f"rank-{i}.json").write_text('["x"]')
    with pytest.raises(FileNotFoundError):
        S.read_rank_files(spark, str(ranks), "json", num_processes=3)
    (tmp_path / "rec.jsonl").write_text('{"news": "a"}\n{"news": "b\n')
    with pytest.raises(Exception):
        S.read_records(spark, str(tmp_path / "rec.jsonl"), fmt="lines").collect()


def test_part_files_sort_by_number():
    from sparkprep.sources.files import _natural
    names = ["part-99999-a.txt", "part-100000-a.txt", "part-00002-a.txt"]
    assert sorted(names, key=_natural) == [names[2], names[0], names[1]]


def test_sparse_ids_shard_by_position(spark):
    from pyspark.sql import functions as F
    from sparkprep.operators.order import assign_shard
    d = spark.range(100).select((F.col("id") * 10).alias("idx"))
    assert sorted(r["count"] for r in assign_shard(d, 4).groupBy("shard").count().collect()) == [25] * 4


def test_factories_are_told_apart():
    from functools import partial
    from sparkprep.operators.generate import _model_for
    assert _model_for(partial(str, "A")) == "A" and _model_for(partial(str, "B")) == "B"


def _small_splits(spark, size="300"):
    import contextlib

    @contextlib.contextmanager
    def held():
        keys = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1"}
        old = {k: spark.conf.get(k) for k in keys}
        for k, v in keys.items():
            spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
    return held()


def _json_value(rnd, depth=0):
    k = rnd.randrange(9 if depth < 3 else 6)
    if k < 3:
        return "".join(rnd.choice('ab,"\\[]{} \u00e9\n\t\U0001f389:') for _ in range(rnd.randrange(0, 30)))
    if k == 3:
        return rnd.choice([None, True, False])
    if k < 6:
        return rnd.choice([rnd.randrange(-10, 10 ** 6), rnd.random()])
    if k < 8:
        return {f'k{i},"': _json_value(rnd, depth + 1) for i in range(rnd.randrange(4))}
    return [_json_value(rnd, depth + 1) for _ in range(rnd.randrange(4))]


@pytest.mark.parametrize("seed", [1, 2])
def test_json_arrays_cut_in_many_splits(spark, tmp_path, seed):
    """Elements of any kind, files of any layout: as json.load, in file order."""
    import random
    from sparkprep.sources.arrays import array_elements
    rnd, want = random.Random(seed), []
    for i in range(11):
        values = [_json_value(rnd) for _ in range(rnd.choice([0, 1, 2, 40]))]
        want += values
        text = json.dumps(values, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 2]))
        (tmp_path / f"rank-{i}.json").write_text(rnd.choice(["", "\ufeff", " \n"]) + text + rnd.choice(["", "\n"]))
    with _small_splits(spark):
        got = sorted((r.idx, r.text) for r in array_elements(spark, str(tmp_path)).collect())
    assert [i for i, _ in got] == list(range(len(want)))
    assert [json.loads(t) for _, t in got] == want


def test_split_sums_compose():
    """The start of any split follows from the sums of those before it."""
    import random
    import pyarrow as pa
    from sparkprep.sources import arrays
    rnd = random.Random(4)
    text = json.dumps([_json_value(rnd) for _ in range(60)])
    pieces = text.split(",")
    cuts = sorted(rnd.sample(range(1, len(pieces)), 7))
    blocks = [i for a, b, i in zip([0, *cuts], [*cuts, len(pieces)], range(99)) for _ in range(b - a)]
    batch = pa.RecordBatch.from_pydict({"file": ["f"] * len(pieces), "block": blocks, "value": pieces})
    (out,) = arrays.split_sums(iter([batch]))
    begin, last = arrays.starts([type("R", (), {"__getitem__": lambda s, k: s.d[k], "d": d})() for d in out.to_pylist()])
    assert last["f"] == 59
    for block, cut in enumerate([0, *cuts]):
        inside, depth, before = begin[("f", block)]
        head = ",".join(pieces[:cut])
        whole = arrays._ESCAPE.sub("", head)
        assert inside == whole.count('"') % 2
        free = "".join(whole.split('"')[0::2])
        assert depth == sum(free.count(c) for c in "[{") - sum(free.count(c) for c in "]}")


@pytest.mark.parametrize("text", ['["a", "b', "[1, 2", "[1]]", '{"a": 1}', "1, 2"])
def test_files_that_are_no_array_fail(spark, tmp_path, text):
    from sparkprep.sources.arrays import array_elements
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="JSON array"):
        array_elements(spark, str(tmp_path / "bad.json")).collect()


def test_empty_arrays_and_large_array_in_many_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(" [ \n] ")
    assert S.read_string_list(spark, str(tmp_path / "a.json")).count() == 0
    texts = [f'line {i}, "quoted" \\ [x' * (i % 5) for i in range(3000)]
    (tmp_path / "b.json").write_text(json.dumps(texts))
    with _small_splits(spark, "16384"):
        pieces = spark.read.option("lineSep", ",").text(str(tmp_path / "b.json"))
        assert pieces.rdd.getNumPartitions() > 5
        got = sorted((r.pos, r.text) for r in S.read_string_list(spark, str(tmp_path / "b.json")).collect())
    assert got == list(enumerate(texts))
    (tmp_path / "c.json").write_text('["a", 3]')
    with pytest.raises(Exception, match="JSON string"):
        S.read_string_list(spark, str(tmp_path / "c.json")).collect()


MIXED = [{"news": "a", "ecnc": True, "ans": 1.50}, {"news": "true", "ecnc": "true", "ans": "1.50"},
         {"news": True, "ecnc": "False", "ans": None}, {"ecnc": False, "ans": [1, True], "masked headline": False}]


@pytest.mark.parametrize("fmt", ["array", "lines"])
def test_records_render_each_value_by_its_own_type(spark, tmp_path, fmt):
    p = tmp_path / "r.json"
    p.write_text(json.dumps(MIXED) if fmt == "array" else "\n".join(map(json.dumps, MIXED)) + "\n\n")
    got = S.read_records(spark, str(p), fmt=fmt).orderBy("idx").collect()
    assert [r.ecnc for r in got] == ["True", "true", "False", "False"]
    assert [r.news for r in got] == ["a", "true", "True", None]
    assert [r.ans for r in got] == ["1.5", "1.50", None, "[1,true]"]
    assert [r.masked_headline for r in got] == [None, None, None, "False"]


def test_floats_read_as_python_prints_them(spark, tmp_path):
    spelled = ["1.50", "10000000000.0", "1e3", "2.5", "3", "-0.0", "0.0001", "0.00001", "1e16", "123456789012345678.5", "1.5E-7", "1e-300",
               "-12.0340", "1e22", "0.1", "1.7976931348623157e308", "12345678901234567890123", "100.0", "9999999999999998.0"]
    p = tmp_path / "f.jsonl"
    p.write_text("\n".join('{"ans": %s, "news": "%s"}' % (x, x) for x in spelled))
    got = S.read_records(spark, str(p), fmt="lines").orderBy("idx").collect()
    assert [r.news for r in got] == spelled
    assert [(x, r.ans) for x, r in zip(spelled, got)] == [(x, str(json.loads(x))) for x in spelled]


def test_records_of_lines_are_scanned_once(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text("\n".join(map(json.dumps, MIXED * 50)))
    plan = S.read_records(spark, str(p), fmt="lines")._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan.split("Relation")[0] or str(p) not in plan      # only the written copy is read later


def test_positions_do_not_depend_on_later_split_settings(spark, tmp_path):
    p = tmp_path / "big.txt"
    lines = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    p.write_text("\n".join(lines))
    with _small_splits(spark, "8192"):
        df = S.read_lines(spark, str(p))
    with _small_splits(spark, "1024"):
        assert {r.pos: r.text for r in df.collect()} == {i: x.strip() for i, x in enumerate(lines)}


def test_natural_order_as_a_column(spark):
    from pyspark.sql import functions as F
    names = ["part-99999-a.txt", "part-100000-a.txt", "part-00002-a.txt", "part-2b", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(S._natural_order(F.col("n"))).collect()]
    assert got == ["", "part-2b", names[2], names[0], names[1]] or got == ["", names[2], "part-2b", names[0], names[1]]


def test_json_array_files_round_trip(spark, tmp_path):
    from sparkprep.sources.sinks import write_json_arrays
    rows = [(i, None if i == 3 else f'text, "{i}" [\n\u00e9') for i in range(40)]
    df = spark.createDataFrame(rows, "idx long, text string").repartition(5)
    write_json_arrays(df, str(tmp_path / "out"))
    names = sorted(os.listdir(tmp_path / "out"))
    assert names and all(n.startswith("rank-") for n in names)
    merged = [x for n in sorted(names, key=S._natural) for x in json.load(open(tmp_path / "out" / n))]
    assert merged == [t for _, t in rows]
    got = S.read_rank_files(spark, str(tmp_path / "out"), "json", num_processes=len(names)).collect()
    assert sorted((r.idx, r.text) for r in got) == rows


def test_arrow_shards_round_trip_by_a_path_only_spark_can_open(spark, tmp_path):
    from sparkprep.sources.sinks import write_arrow_shards
    rows = [(i, f"news {i}", f"c{i}", None if i == 7 else f"r{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "pair_id long, news string, chosen string, rejected string").repartition(4)
    write_arrow_shards(df, str(tmp_path / "pairs"), "pair_id")
    state = json.load(open(tmp_path / "pairs" / "state.json"))
    assert len(state["_data_files"]) > 1
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.pairs.link./in", f"file://{tmp_path}")
    for path in (str(tmp_path / "pairs"), "viewfs://pairs/in/pairs"):
        assert sorted(map(tuple, S.read_pairs(spark, path).select("idx", "news", "chosen", "rejected").collect())) == rows
    os.rename(tmp_path / "pairs" / state["_data_files"][0]["filename"], tmp_path / "pairs" / "other.arrow")
    with pytest.raises(FileNotFoundError):
        S.read_pairs(spark, str(tmp_path / "pairs"))


def test_pairs_are_joined_without_a_second_shuffle_of_the_joined_texts(spark, tmp_path):
    from sparkprep.plans import fixtures as fx
    rows = [(i, f"t{i}") for i in range(30) if i != 11] + [(3, "again"), (None, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = fx.pairs(spark, str(tmp_path))
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3
        got = sorted(map(tuple, pairs.select("pair_id", "news", "chosen", "rejected").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == sorted((a, t, u, v) for a, t in rows for b, u in rows for c, v in rows
                         if None not in (a, b, c) and b == a + 1 and c == a + 2)


def test_arrow_pairs_are_read_without_a_copy(spark, tmp_path):
    import glob
    from sparkprep.session import shared_dir
    from sparkprep.sources.sinks import write_arrow_shards
    rows = [(i, f"news {i}", f"c{i}", f"r{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "pair_id long, news string, chosen string, rejected string")
    write_arrow_shards(df, str(tmp_path / "pairs"), "pair_id")
    folder = shared_dir(spark).replace("file:", "")
    before = set(glob.glob(folder + "/*"))
    got = S.read_pairs(spark, str(tmp_path / "pairs"))
    assert sorted(map(tuple, got.select("idx", "news", "chosen", "rejected").collect())) == rows
    assert set(glob.glob(folder + "/*")) == before


def test_no_arrow_shard_is_held_whole_to_read_it(spark, tmp_path):
    from sparkprep.sources.sinks import write_arrow_shards
    rows = [(i, f"news {i} " + "é\0x" * (i % 40), "" if i % 3 else None, f"r{i}") for i in range(12000)]
    df = spark.createDataFrame(rows, "pair_id long, news string, chosen string, rejected string")
    settings = {"spark.sql.sources.binaryFile.maxLength": "4096",       # the longest file that Spark holds whole
                "spark.sql.files.maxPartitionBytes": "16k", "spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        write_arrow_shards(df, str(tmp_path / "pairs"), "pair_id")
        got = S.read_pairs(spark, str(tmp_path / "pairs"))
        assert sorted(map(tuple, got.select("idx", "news", "chosen", "rejected").collect()), key=lambda r: r[0]) == rows
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name in (f for f in os.listdir(tmp_path / "pairs") if f.endswith(".arrow")):
        assert os.path.getsize(tmp_path / "pairs" / name) > 16 << 10
        assert max(b.num_rows for b in pa.ipc.open_stream(str(tmp_path / "pairs" / name))) <= 1000


def test_arrow_shards_of_other_writers(spark, tmp_path):
    """Files and streams, compressed, cut after the last batch, of any name, listed twice or not at all."""
    def table(s, n=2500):
        return pa.table({"news": [f"n{s} {i}" for i in range(n)], "more": pa.array(range(n), pa.int64()),
                         "chosen": pa.array(["a", "b"] * (n // 2) + ["c"] * (n % 2)).dictionary_encode(),
                         "rejected": pa.array([None if i % 5 else "r" * i for i in range(n)], pa.large_string())})

    def save(name, t, new=pa.ipc.new_stream, cut=0, **options):
        buf = pa.BufferOutputStream()
        with new(buf, t.schema, options=pa.ipc.IpcWriteOptions(**options)) as w:
            w.write_table(t, max_chunksize=1200)
        data = buf.getvalue().to_pybytes()
        (tmp_path / name).write_bytes(data[:len(data) - cut])

    save("data 1%20+ü.arrow", table(0))
    save("file.arrow", table(1), pa.ipc.new_file)
    save("packed.arrow", table(2), compression="zstd")
    save("no end.arrow", table(3), cut=8)
    save("none.arrow", table(4, 0))
    save("not listed.arrow", table(5))
    names = ["file.arrow", "none.arrow", "no end.arrow", "file.arrow", "data 1%20+ü.arrow", "packed.arrow"]
    state = lambda names: (tmp_path / "state.json").write_text(json.dumps({"_data_files": [{"filename": n} for n in names]}))
    state(names)
    want = [r for s in (1, 3, 1, 0, 2) for r in table(s).select(["news", "chosen", "rejected"]).to_pylist()]
    got = sorted(S.read_pairs(spark, str(tmp_path)).collect())
    assert [tuple(r) for r in got] == [(i, r["news"], r["chosen"], r["rejected"]) for i, r in enumerate(want)]
    state([])
    assert S.read_pairs(spark, str(tmp_path)).collect() == []

    def fails():
        with pytest.raises(Exception):
            S.read_pairs(spark, str(tmp_path)).collect()
    save("cut.arrow", table(6), cut=100)
    state(["file.arrow", "cut.arrow"])
    fails()
    (tmp_path / "nothing.arrow").write_bytes(b"")
    state(["nothing.arrow"])
    fails()
    (tmp_path / "text.arrow").write_bytes(b"no Arrow at all")
    state(["text.arrow"])
    fails()
