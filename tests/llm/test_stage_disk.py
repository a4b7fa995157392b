"""What the stages of the pipeline leave in the shared folder, and rows that are alike."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkprep.llm import mixing, neardup
from sparkprep.llm.common import saved, settled
from sparkprep.session import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    noise = lambda n: "".join(chr(rnd.randrange(0x21, 0x7F)) for _ in range(n))
    texts = [" ".join(noise(7) for _ in range(400)) for _ in range(60)]
    out = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    out += [(100 + i, t + " x", "de", "s1") for i, t in enumerate(texts[:9])]           # near copies
    out += [out[3], out[3], (None, texts[5], None, "s0"), (None, texts[5], "s0", None)]  # alike; nulls in other places
    return out + [(7, None, None, None), (7, None, None, None), (None, "", "en", "s2"), (8, " ", "en", "s2")]


def written(spark, make):
    """Bytes that ``make`` leaves in the shared folder, and its rows."""
    folder = shared_dir(spark).replace("file:", "")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)
    before = size()
    out = make()
    return size() - before, out.collect()


def test_near_copies_go_without_a_copy_of_the_texts(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA).withColumn("more", F.create_map(F.lit("k"), F.array("lang", "source")))
    left, got = written(spark, lambda: neardup.one_of_each(d, 80))
    plain = Counter((r.doc_id, r.text, r.lang, r.source) for r in got)
    # the first row of each group in the order of the scan; rows without words all stay
    assert plain == Counter(rows[:60] + rows[-4:])
    assert left < 0.2 * sum(len(r[1] or "") for r in rows)


def test_wanted_texts_take_one_worker_a_core(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA)
    sets = neardup.signatures(d).filter("n_shingles > 0 and doc_id < 30").select(
        F.col("doc_id").alias("cls"), F.col("doc_id").alias("rep"), "set_hash").distinct()
    out = neardup._texts(d, saved(sets, "wanted"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    one, other = (plan.index(x) for x in ("of_class", "let_through"))
    assert "Exchange" in plan[one:other] and "BroadcastHashJoin" not in plan[one:other]
    want = {r[0]: r[1] for r in rows if r[0] is not None and r[0] < 30 and (r[1] or "").split()}
    assert {r.cls: r.text for r in out.collect()} == want


def test_the_mix_is_not_written_before(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA)
    left, got = written(spark, lambda: mixing.mixed_rows(d))
    plan = {(r.doc_id, r.size, r.source): r.taken for r in mixing.mix(d.select("*")).collect() if r.size > 1}
    taken = Counter((r.doc_id, len((r.text or "").split()), r.source) for r in got)
    copies = Counter((r[0], len((r[1] or "").split()), r[3]) for r in rows)
    assert all(n == plan[k] // k[1] for k, n in taken.items() if k in plan and copies[k] == 1)
    assert left < 0.2 * sum(len(r[1] or "") for r in rows)


def test_settled_keeps_its_result_only(spark):
    paths = []

    def step(n):
        a = saved(spark.range(n), "on-the-way")
        b = settled(spark, lambda: saved(a.filter("id > 2"), "inside"), "inner")
        paths.extend([a, b])
        return b.selectExpr("id * 2 as id")

    out = settled(spark, lambda: step(6), "outer")
    assert sorted(r.id for r in out.collect()) == [6, 8, 10]
    assert not any(os.path.exists(f.replace("file://", "")) for d in paths for f in d.inputFiles())
    again = saved(out, "later")
    settled(spark, lambda: out.limit(1), "other")
    assert again.count() == out.count() == 3
