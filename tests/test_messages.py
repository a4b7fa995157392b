import pytest
from pyspark.sql import functions as F

from sparkprep.operators import templates as T
from sparkprep.operators.messages import build_messages, explode_messages, render, prompt_messages
from sparkprep.operators.pairs import template_pairs

REC = dict(idx=0, news="  The news.  ", headline=" Head 5 ", masked_headline=" ____ head ",
           ans=" 5 ", summary=" sum ", rationale_hg=" focus it ", rationale_cal=" 2+3 ",
           ecnc=None, rationale_hg_stg1=" gen r1 ", rationale_nr_stg1=" gen r2 ")
SCHEMA = ", ".join(f"{k} {'bigint' if k == 'idx' else 'string'}" for k in REC)


@pytest.fixture(scope="module")
def rec(spark):
    return spark.createDataFrame([tuple(REC.values())], SCHEMA)


def _msgs(rec, task, mode):
    rows = explode_messages(build_messages(rec, task, mode)).orderBy("pos").collect()
    return [(r.role, r.content) for r in rows]


# Hand goldens (expected strings written out by hand from the layout rules)
GOLDEN = [
    ("hg", T.TRAIN, "news: The news.", "Head 5"),
    ("rationale_hg_stg1_cal", T.TRAIN, "news: The news.", "calculation: 2+3"),
    ("rationale_hg_stg1_cal", T.INFER, "news: The news.", "calculation:  2+3 "),
    ("rationale_hg_stg1_ec", T.TRAIN, "news: The news.", "summary: sum focus: focus it calculation:  2+3 "),
    ("rationale_hg_stg1_ecnc", T.TRAIN, "news: The news.", "None"),
    ("rationale_hg_stg2_cal", T.TRAIN, "news: The news. calculation: 2+3", "Head 5"),
    ("rationale_hg_stg2_cal", T.INFER, "news: The news. gen r1", "Head 5"),
    ("rationale_hg_stg2_ecnc", T.TRAIN, "news: The news.\n\nNone", "Head 5"),
    ("rationale_hg_stg2_ecnc", T.INFER, "news: The news.\n\ngen r1", "Head 5"),
    ("nr", T.TRAIN, "news: The news. masked headline: ____ head", "5"),
    ("rationale_nr_stg1_ec", T.TRAIN, "news: The news. masked headline: ____ head",
     "summary: sum focus: focus it calculation: 2+3"),
    ("rationale_nr_stg2_ec", T.TRAIN,
     "news: The news. masked headline: ____ head summary: sum focus: focus it calculation: 2+3", "5"),
    ("rationale_nr_stg2_ec", T.INFER, "news: The news. masked headline: ____ head gen r2", "5"),
    ("rationale_nr_stg2_ecnc", T.TRAIN, "news: The news.\n\nNone", "5"),
    ("rationale_nr_stg2_ecnc", T.INFER, "news: The news.\n\ngen r2", "5"),
    ("hg", T.INFER, "news: The news.", "Head 5"),
    ("rationale_hg_stg1_emp", T.TRAIN, "news: The news.", "focus: focus it"),
    ("rationale_hg_stg1_emp", T.INFER, "news: The news.", "focus: focus it"),
    ("rationale_hg_stg1_ec", T.INFER, "news: The news.", "summary: sum focus: focus it calculation:  2+3 "),
    ("rationale_hg_stg1_ecnc", T.INFER, "news: The news.", "None"),
    ("rationale_hg_stg2_emp", T.TRAIN, "news: The news. focus: focus it", "Head 5"),
    ("rationale_hg_stg2_emp", T.INFER, "news: The news. gen r1", "Head 5"),
    ("rationale_hg_stg2_ec", T.TRAIN, "news: The news. summary: sum focus: focus it calculation:  2+3 ", "Head 5"),
    ("rationale_hg_stg2_ec", T.INFER, "news: The news. gen r1", "Head 5"),
    ("nr", T.INFER, "news: The news. masked headline: ____ head", "5"),
    ("rationale_nr_stg1_ec", T.INFER, "news: The news. masked headline: ____ head",
     "summary: sum focus: focus it calculation: 2+3"),
    ("rationale_nr_stg1_ecnc", T.TRAIN, "news: The news. masked headline: ____ head", "None"),
    ("rationale_nr_stg1_ecnc", T.INFER, "news: The news. masked headline: ____ head", "None"),
]


def test_goldens_cover_all_28_layouts():
    assert {(t, m) for t, m, _, _ in GOLDEN} == {(t, m) for t in T.TASKS for m in T.MODES}


@pytest.mark.parametrize("task,mode,user,assistant", GOLDEN)
def test_message_goldens(rec, task, mode, user, assistant):
    m = _msgs(rec, task, mode)
    assert [r for r, _ in m] == ["system", "user", "assistant"]
    assert m[0][1] == T.SYSTEM_TEXTS[(task, mode)]
    assert m[1][1] == user
    assert m[2][1] == assistant


def test_all_28_layouts_build(rec):
    for task in T.TASKS:
        for mode in T.MODES:
            assert len(_msgs(rec, task, mode)) == 3


def test_unknown_task_fails_at_plan_time(rec):
    with pytest.raises(ValueError):
        build_messages(rec, "no_such_task")
    with pytest.raises(ValueError):
        build_messages(rec.drop("ecnc"), "rationale_hg_stg1_ecnc")


def test_render_chatml(rec):
    m = build_messages(rec, "hg", T.INFER)
    full, prompt = m.select(render("messages"), render(prompt_messages("messages"), True)).first()
    sys_text = T.SYSTEM_TEXTS[("hg", T.INFER)]
    assert prompt == (f"<|im_start|>system\n{sys_text}<|im_end|>\n"
                      "<|im_start|>user\nnews: The news.<|im_end|>\n<|im_start|>assistant\n")
    assert full.endswith("<|im_start|>assistant\nHead 5<|im_end|>\n")


def test_template_pairs(spark):
    df = spark.createDataFrame([(1, " n ", "good", None)], "pair_id int, news string, chosen string, rejected string")
    r = template_pairs(df, "hg").first()
    sys_text = T.SYSTEM_TEXTS[("hg", T.TRAIN)]
    assert r.prompt == (f"<|im_start|>system\n{sys_text}<|im_end|>\n"
                        "<|im_start|>user\nnews:  n <|im_end|>\n<|im_start|>assistant\n")
    assert r.chosen == "good<|im_end|>\n" and r.rejected == "None<|im_end|>\n"
    assert "news" not in template_pairs(df, "hg").columns
    with pytest.raises(ValueError):
        template_pairs(df, "nr")


def test_task_kind_routing():
    k = T.task_kind("rationale_hg_stg1_ecnc")
    assert (k.stage, k.output_format, k.rationale_column) == (1, "json", "rationale_hg_stg1")
    k = T.task_kind("rationale_nr_stg2_ec")
    assert (k.stage, k.output_format, k.rationale_column) == (2, "txt", "rationale_nr_stg1")


def test_task_column_unknown_task_fails(spark, rec):
    from sparkprep.operators.messages import messages_by_task_column
    tpl = T.template_table(spark)
    ok = rec.withColumn("task", F.lit("nr"))
    assert messages_by_task_column(ok, tpl).first().messages[2].content == "5"
    bad = rec.withColumn("task", F.lit("nope"))
    with pytest.raises(Exception):
        messages_by_task_column(bad, tpl).collect()


def test_render_fixed_length_matches_general(rec):
    m = build_messages(rec, "nr", T.TRAIN)
    a, b, c, d = m.select(render("messages"), render("messages", n=3),
                          render(prompt_messages("messages"), True), render(prompt_messages("messages"), True, n=2)).first()
    assert a == b and c == d
