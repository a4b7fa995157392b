import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkprep.operators import order as OR
from sparkprep.operators import ranges


def _skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    # one group holds about a third of the rows
    rows = [(i, 0 if rnd.random() < 0.34 else rnd.randint(1, 40), rnd.randint(0, 10 ** 6)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g int, v long")


def test_global_position_matches_row_number(spark):
    df = _skewed(spark)
    got = {r.id: r.pos for r in OR.with_position(df, ["v", "id"], partitions=7).collect()}
    want = {r.id: r.rn - 1 for r in df.select("id", F.row_number().over(Window.orderBy("v", "id")).alias("rn")).collect()}
    assert got == want


def test_position_in_hot_group_matches_row_number(spark):
    df = _skewed(spark)
    got = {r.id: r.pos for r in OR.with_position(df, ["v", "id"], partition_by=["g"], partitions=9).collect()}
    w = Window.partitionBy("g").orderBy("v", "id")
    want = {r.id: r.rn - 1 for r in df.select("id", F.row_number().over(w).alias("rn")).collect()}
    assert got == want


def test_position_plan_has_no_unpartitioned_window(spark):
    df = _skewed(spark, 200)
    plan = OR.with_position(df, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    grouped = OR.with_position(df, ["v"], partition_by=["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" in grouped and "SinglePartition" not in grouped


def test_position_by_unique_keys_moves_keys_only(spark):
    rows = [(None if i == 7 else i * 37 % 1000, i % 3, "wide " * 20) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, g int, text string")
    got = OR.with_position(df, ["k"], unique=True, partitions=5)
    assert got.columns == ["k", "g", "text", "pos"]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert {(r.k, r.pos) for r in got.collect()} == {(k, i) for i, (k, _, _) in enumerate(order)}
    inside = OR.with_position(df, ["k"], partition_by=["g"], unique=True, partitions=5).collect()
    for g in range(3):
        part = [k for k, h, _ in order if h == g]
        assert {(r.k, r.pos) for r in inside if r.g == g} == {(k, i) for i, k in enumerate(part)}
    with pytest.raises(Exception, match="share their order columns"):
        OR.with_position(df.withColumn("k", F.lit(1)), ["k"], unique=True).collect()


@pytest.mark.parametrize("total,n", [(10, 3), (2, 8), (16, 8), (0, 3), (1000, 8), (7, 7)])
def test_shard_formula(spark, total, n):
    def ref(i):  # contiguous chunks, last shard takes the rest
        chunk = total // n
        for s in range(n):
            start = s * chunk
            end = start + chunk if s != n - 1 else total
            if start <= i < end:
                return s
    df = spark.range(total).withColumnRenamed("id", "idx")
    got = {r.idx: r.shard for r in OR.assign_shard(df, n).collect()}
    assert got == {i: ref(i) for i in range(total)}


def test_merge_inverts_shard(spark):
    df = spark.range(103).withColumnRenamed("id", "idx")
    sh = OR.assign_shard(df, 6)
    within = OR.with_position(sh, ["idx"], partition_by=["shard"], name="pos")
    merged = OR.merge_shards(within, "shard", "pos", "m").collect()
    assert all(r.m == r.idx for r in merged) and len(merged) == 103


@pytest.mark.parametrize("n,frac", [(1000, 0.02), (50, 0.1), (3, 0.5), (10, 0.0), (10, 1.0)])
def test_split_exact(spark, n, frac):
    df = spark.range(n).withColumnRenamed("id", "k")
    s = OR.split_exact(df, "k", frac, seed=42)
    rows = s.collect()
    test = {r.k for r in rows if r.split == "test"}
    assert len(rows) == n and len(test) == math.ceil(frac * n)
    # the smallest hashes, stable under repartitioning
    order = [r.k for r in df.orderBy(OR.shuffle_key("k", 42), "k").collect()]
    assert test == set(order[: math.ceil(frac * n)])
    again = {r.k for r in OR.split_exact(df.repartition(5), "k", frac, seed=42).collect() if r.split == "test"}
    assert again == test


def test_preview_and_first_row(spark):
    df = spark.range(20).withColumnRenamed("id", "idx")
    assert len(OR.preview(df, "idx", 5).collect()) == 5
    assert len(OR.preview(df, "idx", 50).collect()) == 20
    assert OR.first_row(df.repartition(3)).first().idx == 0


def test_running_total(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(200)], "idx long, w long")
    got = {r.idx: r.start for r in OR.with_running_total(df, ["idx"], "w", partitions=6).collect()}
    acc, want = 0, {}
    for i in range(200):
        want[i] = acc
        acc += i % 5
    assert got == want


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "idx long, w long")
    assert OR.with_position(empty, ["idx"]).count() == 0
    assert OR.with_position(empty, ["idx"], partition_by=["w"]).count() == 0
    assert OR.split_exact(empty, "idx", 0.02).count() == 0
    assert OR.assign_shard(empty, 4).count() == 0
    assert OR.with_running_total(empty, ["idx"], "w").count() == 0


def test_tied_hot_key_is_split_across_partitions(spark):
    # a third of the rows share one order key; positions stay a permutation
    rows = [(i, 0 if i % 3 == 0 else i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k long")
    out = OR.with_position(df, ["k"], partitions=8)
    got = sorted(r.pos for r in out.collect())
    assert got == list(range(3000))
    hot = OR.sorted_checkpoint(df, ["k"], 8).where("k = 0").groupBy("_pid").count().collect()
    assert len(hot) > 1


from hypothesis import given, settings, strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None)
@given(st.integers(min_value=0, max_value=400), st.integers(min_value=1, max_value=12))
def test_shard_then_merge_is_identity(spark, n, shards):
    df = spark.range(n).withColumnRenamed("id", "idx")
    sh = OR.assign_shard(df, shards)
    sizes = {r.shard: r["count"] for r in sh.groupBy("shard").count().collect()}
    assert sum(sizes.values()) == n
    within = OR.with_position(sh, ["idx"], partition_by=["shard"], name="pos", partitions=5)
    merged = OR.merge_shards(within, "shard", "pos", "m").collect()
    assert sorted((r.m, r.idx) for r in merged) == [(i, i) for i in range(n)]


def test_split_exact_of_repeated_rows_and_null_keys(spark):
    rows = [(7, "x")] * 400 + [(None, "y")] * 30 + [(i, "z") for i in range(570)]
    for fraction in (0.01, 0.02, 0.3, 0.5, 0.77):
        got = OR.split_exact(spark.createDataFrame(rows, "k long, v string"), "k", fraction).collect()
        assert len(got) == 1000 and sum(r.split == "test" for r in got) == math.ceil(fraction * 1000)
        assert sorted((r.k is None, r.k or 0, r.v) for r in got) == sorted((k is None, k or 0, v) for k, v in rows)


def test_split_exact_has_neither_window_nor_union(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    plan = OR.split_exact(df, "k", 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Union" not in plan and "Exchange" not in plan


def test_kth_code_by_radix(spark, monkeypatch):
    monkeypatch.setattr(ranges, "_FEW", 0)          # every round by histogram
    rnd = random.Random(5)
    codes = [f"{rnd.choice([1, 2, 3, rnd.randrange(16 ** 4)]):04x}{rnd.randrange(3):04x}{rnd.randrange(2):04x}" for _ in range(700)]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    for k in (1, 2, 99, 350, 700):
        code, taken, there = ranges.kth_code(df, lambda n: k)
        assert code == sorted(codes)[k - 1]
        assert there == codes.count(code) and taken == k - sum(c < code for c in codes)
    assert ranges.kth_code(df, lambda n: 0) == (None, 0, 0)


def _hand_totals(rows, key):
    """Running totals of (key, weight, ...) rows; ties may come in any order."""
    out, acc = {}, 0
    for r in sorted(rows, key=key):
        out[r[2]] = acc
        acc += r[1] or 0
    return out, acc


KEYS = {
    "outlier long": ("long", lambda i, rnd: 2 ** 62 if i == 0 else -2 ** 63 if i == 1 else i),
    "64-bit hash long": ("long", lambda i, rnd: rnd.randrange(-2 ** 63, 2 ** 63)),
    "null long": ("long", lambda i, rnd: None if i == 5 else i),
    "string": ("string", lambda i, rnd: f"k{rnd.random()}é" if i else None),
    "double": ("double", lambda i, rnd: float("nan") if i == 3 else rnd.gauss(0, 1e6)),
    "decimal(30,4)": ("decimal(30,4)", lambda i, rnd: __import__("decimal").Decimal(rnd.randrange(10 ** 20)) / 1000),
}


@pytest.mark.parametrize("kind", list(KEYS))
def test_running_total_over_any_key(spark, kind):
    sql, make = KEYS[kind]
    rnd = random.Random(3)
    rows = [(make(i, rnd), rnd.choice([None, 0, 1, 7]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, f"k {sql}, w long, id long")
    nan = lambda k: isinstance(k, float) and math.isnan(k)
    want, _ = _hand_totals(rows, lambda r: (r[0] is not None, nan(r[0]), 0 if r[0] is None or nan(r[0]) else r[0]))
    got = {r.id: r.start for r in OR.with_running_total(df, ["k"], "w", partitions=16).collect()}
    assert got == want


def test_no_range_holds_more_than_twice_its_share(spark):
    # a third of the rows share one key, some rows are equal in all columns, and one key is far off
    rows = [(2 ** 62,)] + [(5,)] * 10_000 + [(i * i,) for i in range(20_000)]
    table = ranges.written(spark.createDataFrame(rows, "k long").repartition(5), "test")
    key = ranges.sort_key([F.col("k")])
    sizes = [r["count"] for r in ranges.with_range(table, key, 25).groupBy("_range").count().collect()]
    assert len(sizes) == 25 and max(sizes) <= 2 * len(rows) / 25
    wrong = ranges.with_range(table, key, 25).groupBy("_range").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).collect()
    ends = [(r.lo, r.hi) for r in sorted(wrong, key=lambda r: r._range)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_running_total_sorts_each_range_only(spark):
    df = spark.range(5000).select("id", F.lit(1).alias("w"))
    plan = OR.with_running_total(df, ["id"], "w", partitions=12)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_range") == 1 and "rangepartitioning" not in plan


def test_position_with_two_group_columns(spark):
    import random
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", None]), 0 if rnd.random() < 0.5 else rnd.randint(1, 3), rnd.random())
            for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, g1 string, g2 int, v double")
    got = {r.id: r.pos for r in OR.with_position(df, ["v", "id"], partition_by=["g1", "g2"], partitions=7).collect()}
    w = Window.partitionBy("g1", "g2").orderBy("v", "id")
    want = {r.id: r.rn - 1 for r in df.select("id", F.row_number().over(w).alias("rn")).collect()}
    assert got == want


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50)), min_size=0, max_size=300),
       st.integers(min_value=1, max_value=9))
def test_position_in_group_property(spark, rows, parts):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "id long, g int, v int")
    got = {r.id: r.pos for r in OR.with_position(df, ["v", "id"], partition_by=["g"], partitions=parts).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        ids = sorted((v, i) for i, (gg, v) in enumerate(rows) if gg == g)
        want.update({i: p for p, (_, i) in enumerate(ids)})
    assert got == want


@settings(max_examples=6, deadline=None)
@given(st.integers(min_value=0, max_value=600), st.floats(min_value=0.0, max_value=1.0),
       st.integers(min_value=1, max_value=7))
def test_split_exact_property(spark, n, frac, parts):
    df = spark.range(n).withColumnRenamed("id", "k").repartition(parts)
    test = {r.k for r in OR.split_exact(df, "k", frac, seed=7).collect() if r.split == "test"}
    order = [r.k for r in spark.range(n).withColumnRenamed("id", "k").orderBy(OR.shuffle_key("k", 7), "k").collect()]
    assert test == set(order[: math.ceil(frac * n)])
