"""All registered queries. Each reads the given tables (through the fixtures)
so that its work grows with the data; each has a DuckDB oracle unless noted."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import templates as T
from ..operators.align import stage2_inputs
from ..operators.messages import build_messages, explode_messages
from . import fixtures as fx
from . import oracle_sql as O
from .registry import add

_MODE_TAG = {T.TRAIN: "train", T.INFER: "infer"}


# ---------------------------------------------------------------------------
# PJ1: 14 tasks x 2 modes, long form (idx, pos, role, content)
# ---------------------------------------------------------------------------
def _pj1(spark, sf_dir, task, mode):
    ex = fx.examples(spark, sf_dir)
    if mode == T.INFER and T.task_kind(task).stage == 2:
        df = stage2_inputs(ex, fx.full_sidecar(spark, sf_dir), task)
    else:
        df = build_messages(ex, task, mode)
    return explode_messages(df)


def _pj1_sql(task, mode):
    if mode == T.INFER and T.task_kind(task).stage == 2:
        rcol = T.task_kind(task).rationale_column
        src = f"(SELECT e.*, s.text AS {rcol} FROM examples e JOIN full_sidecar s ON e.idx = s.idx)"
        return fx.with_fixtures(O.messages_long(task, mode, src), "examples", "full_sidecar")
    return fx.with_fixtures(O.messages_long(task, mode, "examples"), "examples")


for _task in T.TASKS:
    for _mode in T.MODES:
        add(f"pj1_{_task}_{_MODE_TAG[_mode]}", partial(_pj1, task=_task, mode=_mode),
            _pj1_sql(_task, _mode), ("PJ1", "SC1", "SC2", "SC4"))


# ---------------------------------------------------------------------------
# Flagship (entry): stage-1 inference prompts, rendered with generation prompt
# ---------------------------------------------------------------------------
from ..functions import text as TX  # noqa: E402
from ..functions.text import WS29  # noqa: E402
from ..functions.tokens import TOKEN_PATTERN, CONTRACTION_RULES, OVERLAP_SEPARATOR, utf8_tokens  # noqa: E402
from ..operators import generate as G  # noqa: E402
from ..operators import order as OR  # noqa: E402
from ..operators.align import replicate, zip_join  # noqa: E402
from ..operators.lengths import length_profile, pack, pair_length_profile, truncate_left  # noqa: E402
from ..operators.messages import IM_END, messages_by_task_column, prompt_messages, render  # noqa: E402
from ..operators.pairs import fit_pair, pairs_by_gap, template_pairs  # noqa: E402
from ..operators.score import number_accuracy, rouge1  # noqa: E402
from ..session import scratch_path  # noqa: E402


def flagship(spark, sf_dir):
    ex = fx.examples(spark, sf_dir)
    m = build_messages(ex, "rationale_hg_stg1_ecnc", T.INFER)
    return m.select("idx", render(prompt_messages("messages"), add_generation_prompt=True).alias("prompt"))


def _prompt_sql(task, mode, source="examples", keys="idx"):
    user, _ = O.layout(task, mode)
    sys_text = TX.sql_str(T.SYSTEM_TEXTS[(task, mode)])
    return f"SELECT {keys}, " + O.chatml([("'system'", sys_text), ("'user'", O.content(user))], True) + \
        f" AS prompt FROM {source}"


add("pj2_pj3_render_prompt_ecnc_infer", flagship,
    fx.with_fixtures(_prompt_sql("rationale_hg_stg1_ecnc", T.INFER), "examples"), ("PJ2", "PJ3"))


def _render_full(spark, sf_dir):
    ex = fx.examples(spark, sf_dir)
    m = build_messages(ex, "hg", T.TRAIN)
    return m.select("idx", render("messages").alias("text"))


def _render_full_sql(task="hg", mode=T.TRAIN):
    user, asst = O.layout(task, mode)
    sys_text = TX.sql_str(T.SYSTEM_TEXTS[(task, mode)])
    return ("SELECT idx, " + O.chatml([("'system'", sys_text), ("'user'", O.content(user)),
                                       ("'assistant'", O.content(asst))]) + " AS text FROM examples")


add("pj3_render_full_hg_train", _render_full, fx.with_fixtures(_render_full_sql(), "examples"), ("PJ3",))


# ---------------------------------------------------------------------------
# PJ4/PJ5: preference templating
# ---------------------------------------------------------------------------
PAIR_TASK = "rationale_hg_stg1_ecnc"


def _templated(spark, sf_dir):
    return template_pairs(fx.pairs(spark, sf_dir), PAIR_TASK)


def _templated_sql():
    sys_text = TX.sql_str(T.SYSTEM_TEXTS[(PAIR_TASK, T.TRAIN)])
    prompt = (O.chatml([("'system'", sys_text)]) + " || " +
              O.chatml([("'user'", "'news: ' || " + O.to_text("news"))], True))
    eos = f"'{IM_END}' || chr(10)"
    return (f"SELECT pair_id, {prompt} AS prompt, {O.to_text('chosen')} || {eos} AS chosen, "
            f"{O.to_text('rejected')} || {eos} AS rejected FROM pairs")


TEMPLATED_SQL = _templated_sql()
add("pj4_pj5_template_pairs", _templated, fx.with_fixtures(TEMPLATED_SQL, "pairs"), ("PJ4", "PJ5", "UD1"))


# ---------------------------------------------------------------------------
# PJ6 + FL2: the task is a column (picked by language); template table broadcast
# ---------------------------------------------------------------------------
LANG_TASK = {"en": "hg", "fr": "nr", "de": "rationale_hg_stg1_ecnc", "es": "rationale_nr_stg1_ec"}


def _by_task_column(spark, sf_dir):
    ex = fx.examples(spark, sf_dir, extra=("lang",))
    task = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in LANG_TASK.items()], F.lit("hg"))
    df = ex.withColumn("task", task)
    m = messages_by_task_column(df, T.template_table(spark), "task", T.TRAIN, keep=("idx",))
    routed = T.route(m, "task")
    return explode_messages(routed, keep=("idx", "task", "stage", "output_format", "rationale_column"))


def _by_task_column_sql():
    case_task = "CASE " + " ".join(f"WHEN d.lang = '{k}' THEN '{v}'" for k, v in LANG_TASK.items()) + " ELSE 'hg' END"
    sys_case = "CASE " + " ".join(f"WHEN task = '{t}' THEN {TX.sql_str(T.SYSTEM_TEXTS[(t, T.TRAIN)])}"
                                  for t in T.TASKS) + " END"

    def case(which):
        return "CASE " + " ".join(
            f"WHEN task = '{t}' THEN {O.content(O.layout(t, T.TRAIN)[which])}"
            for t in T.TASKS) + " END"
    src = (f"(SELECT e.*, {case_task} AS task FROM examples e JOIN documents d ON d.doc_id = e.idx)")
    routed = (f"(SELECT *, CASE WHEN contains(task, 'stg2') THEN 2 ELSE 1 END AS stage, "
              f"CASE WHEN contains(task, 'stg1') THEN 'json' ELSE 'txt' END AS output_format, "
              f"CASE WHEN contains(task, 'hg') THEN 'rationale_hg_stg1' WHEN contains(task, 'nr') "
              f"THEN 'rationale_nr_stg1' END AS rationale_column FROM {src})")
    keys = "idx, task, stage, output_format, rationale_column"
    rows = [("0", "'system'", sys_case), ("1", "'user'", case(0)), ("2", "'assistant'", case(1))]
    return "\nUNION ALL\n".join(
        f"SELECT {keys}, CAST({p} AS BIGINT) AS pos, {r} AS role, {c} AS content FROM {routed}"
        for p, r, c in rows)


add("pj6_fl2_task_column", _by_task_column, fx.with_fixtures(_by_task_column_sql(), "examples"),
    ("PJ6", "FL2"))


# ---------------------------------------------------------------------------
# PJ7: prompt echo removal by prompt length
# ---------------------------------------------------------------------------
def _strip_prompt(spark, sf_dir):
    c = fx.candidates(spark, sf_dir)
    gen = F.concat("ref", F.lit("  "), "candidate", F.lit("\n"))
    return c.select("idx", "rep", TX.strip_prompt(gen, F.col("ref")).alias("text"))


add("pj7_strip_prompt", _strip_prompt, fx.with_fixtures(
    f"SELECT idx, rep, trim(substr(ref || '  ' || candidate || chr(10), length(ref) + 1), {O.WS}) AS text "
    "FROM candidates", "candidates"), ("PJ7", "SC8", "SC2"))


# ---------------------------------------------------------------------------
# FL1 / SC5: numerals
# ---------------------------------------------------------------------------
PAT = TX.NUMERAL_PATTERN


def _single_number(spark, sf_dir):
    p = fx.predictions(spark, sf_dir)
    return p.select("idx", TX.numeral_count("text").cast("bigint").alias("n_numerals"),
                    TX.has_single_number("text").alias("single"))


add("fl1_single_number", _single_number, fx.with_fixtures(
    f"SELECT idx, CAST(len(regexp_extract_all(text, '{PAT}')) AS BIGINT) AS n_numerals, "
    f"len(regexp_extract_all(text, '{PAT}')) = 1 AS single FROM predictions", "predictions"),
    ("FL1", "SC5", "SC10"))


def _numerals_docs(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    # explode_outer + null filter: a plain explode makes the optimizer add a
    # size(...) > 0 filter that would evaluate the regex a second time
    return (d.select("doc_id", F.posexplode_outer(TX.numerals("text")).alias("pos", "numeral"))
            .where(F.col("pos").isNotNull())
            .withColumn("pos", F.col("pos").cast("bigint")))


add("sc5_numerals_documents", _numerals_docs,
    f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, numeral FROM ("
    f"SELECT doc_id, unnest(regexp_extract_all(text, '{PAT}')) AS numeral, "
    f"generate_subscripts(regexp_extract_all(text, '{PAT}'), 1) AS i FROM documents)", ("SC5",))


# ---------------------------------------------------------------------------
# JN1 / JN3 / GN1 / GN2
# ---------------------------------------------------------------------------
def _zip(spark, sf_dir):
    ex = fx.examples(spark, sf_dir).select("idx", "headline")
    sc = fx.sidecar(spark, sf_dir).select("idx", F.col("text").alias("rationale_hg_stg1"))
    return zip_join(ex, sc)


add("jn1_zip_join", _zip, fx.with_fixtures(
    "SELECT e.idx, e.headline, s.text AS rationale_hg_stg1 FROM examples e JOIN sidecar s ON e.idx = s.idx",
    "examples", "sidecar"), ("JN1",))


def _stage1_outputs_k2(spark, sf_dir):
    """Stage-1 outputs, 2 per record, flattened sample-major (positional)."""
    d = fx.table(spark, sf_dir, "documents")
    r = d.select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("r"))
    return r.select((F.col("doc_id") * 2 + F.col("r")).alias("pos"),
                    F.concat(F.lit(" focus "), F.col("source"), F.lit(" #"), F.col("r").cast("string"))
                    .alias("text"))


def _jn3(spark, sf_dir):
    ex = fx.examples(spark, sf_dir)
    m = stage2_inputs(ex, _stage1_outputs_k2(spark, sf_dir), "rationale_hg_stg2_ecnc", k=2)
    return explode_messages(m, keep=("idx", "rep"))


def _jn3_sql():
    src = ("(SELECT e.*, r.rep, ' focus ' || d.source || ' #' || CAST(r.rep AS VARCHAR) AS rationale_hg_stg1 "
           "FROM examples e JOIN documents d ON d.doc_id = e.idx "
           "CROSS JOIN (SELECT unnest(range(2)) AS rep) r)")
    return fx.with_fixtures(O.messages_long("rationale_hg_stg2_ecnc", T.INFER, src, keys="idx, CAST(rep AS BIGINT) AS rep"),
                            "examples")


add("jn3_stage2_k2", _jn3, _jn3_sql(), ("JN3", "JN1", "GN1", "GN2", "FL2"))


def _replicate3(spark, sf_dir):
    ex = fx.examples(spark, sf_dir).select("idx")
    return replicate(ex, 3).withColumn("rep", F.col("rep").cast("bigint"))


add("gn1_replicate_k3", _replicate3, fx.with_fixtures(
    "SELECT idx, CAST(r AS BIGINT) AS rep, idx * 3 + r AS pos FROM examples, (SELECT unnest(range(3)) AS r)",
    "examples"), ("GN1",))


# ---------------------------------------------------------------------------
# GN3 / GN4 with the deterministic stand-in model
# ---------------------------------------------------------------------------
def _gen(spark, sf_dir):
    ex = fx.examples(spark, sf_dir)
    m = build_messages(ex, "hg", T.INFER)
    out = G.generate(m, G.echo_model, k=2, batch_size=16)
    return out.select("idx", F.col("rep").cast("bigint").alias("rep"), "text")


def _gen_sql():
    inner = _prompt_sql("hg", T.INFER)
    return fx.with_fixtures(
        f"SELECT idx, CAST(rep AS BIGINT) AS rep, CASE WHEN L % 7 <> 0 AND L % 4 = 0 THEN 'answer ' || L "
        f"ELSE 'answer ' || L || ' and 0' END AS text FROM (SELECT idx, length(prompt) AS L FROM ({inner})), "
        f"(SELECT unnest(range(2)) AS rep)", "examples")


add("gn3_generate_k2", _gen, _gen_sql(), ("GN3", "PJ2", "PJ3", "PJ7", "GN1"))


def _gen_resumable(spark, sf_dir):
    m = build_messages(fx.examples(spark, sf_dir), "hg", T.INFER)
    out = G.generate_resumable(m, G.echo_model, scratch_path(spark, "gn3-resumable"), k=2, batch_size=64)
    return out.select("idx", F.col("rep").cast("bigint").alias("rep"), "text")


add("gn3_generate_resumable", _gen_resumable, _gen_sql(), ("GN3", "PJ7"))


def _gen_retry(spark, sf_dir):
    ex = fx.examples(spark, sf_dir)
    m = build_messages(ex, "hg", T.INFER)
    out = G.generate(m, G.echo_model, k=1, batch_size=16, num_check=True)
    return out.select("idx", F.col("attempts").cast("bigint").alias("attempts"), "text")


def _gen_retry_sql():
    inner = _prompt_sql("hg", T.INFER)
    return fx.with_fixtures(
        "SELECT idx, CAST(CASE WHEN L % 7 <> 0 THEN L % 4 ELSE 20 END AS BIGINT) AS attempts, "
        "CASE WHEN L % 7 <> 0 THEN 'answer ' || (L + L % 4) ELSE 'answer ' || L || ' and 20' END AS text "
        f"FROM (SELECT idx, length(prompt) AS L FROM ({inner}))", "examples")


add("gn4_generate_retry", _gen_retry, _gen_retry_sql(), ("GN4", "FL1", "PJ7"))


# ---------------------------------------------------------------------------
# WN1 / WN2
# ---------------------------------------------------------------------------
def _position(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "source")
    return OR.with_position(d, ["source", "doc_id"]).select("doc_id", "pos")


add("wn1_position", _position,
    "SELECT doc_id, CAST(row_number() OVER (ORDER BY source, doc_id) - 1 AS BIGINT) AS pos FROM documents",
    ("WN1",))

add("wn1_position_in_group", lambda spark, sf_dir: fx.attempts(spark, sf_dir),
    fx.with_fixtures("SELECT * FROM attempts", "attempts"), ("WN1",))


def _select_attempt(spark, sf_dir):
    return G.select_attempt(fx.attempts(spark, sf_dir))


add("wn2_select_attempt", _select_attempt, fx.with_fixtures(
    "SELECT idx, CAST(coalesce(arg_min(attempt, attempt) FILTER (WHERE ok), max(attempt)) AS BIGINT) AS attempt, "
    "coalesce(arg_min(text, attempt) FILTER (WHERE ok), arg_max(text, attempt)) AS text FROM ("
    f"SELECT *, len(regexp_extract_all(text, '{PAT}')) = 1 AS ok FROM attempts WHERE attempt <= 20) GROUP BY idx",
    "attempts"), ("WN2",))


# ---------------------------------------------------------------------------
# OS1-OS4, SH1, SH2
# ---------------------------------------------------------------------------
MD5 = "md5('42:' || CAST({k} AS VARCHAR))"

add("os1_shuffle_position", lambda spark, sf_dir: OR.shuffle_position(
        fx.pairs(spark, sf_dir).select("pair_id"), "pair_id"),
    fx.with_fixtures(f"SELECT pair_id, CAST(row_number() OVER (ORDER BY {MD5.format(k='pair_id')}, pair_id) - 1 "
                     "AS BIGINT) AS pos FROM pairs", "pairs"), ("OS1",))

add("os2_split_exact", lambda spark, sf_dir: OR.split_exact(
        fx.examples(spark, sf_dir).select("idx"), "idx", 0.02),
    fx.with_fixtures(f"SELECT idx, CASE WHEN row_number() OVER (ORDER BY {MD5.format(k='idx')}, idx) <= "
                     "ceil(0.02 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM examples",
                     "examples"), ("OS2",))

add("os3_preview_k5", lambda spark, sf_dir: OR.preview(
        fx.examples(spark, sf_dir).select("idx", "headline"), "idx", 5),
    fx.with_fixtures(f"SELECT idx, headline FROM examples ORDER BY {MD5.format(k='idx')}, idx LIMIT 5",
                     "examples"), ("OS3",))


def _first_example(spark, sf_dir):
    first = OR.first_row(fx.examples(spark, sf_dir))
    return explode_messages(build_messages(first, "hg", T.INFER))


add("os4_first_example", _first_example, fx.with_fixtures(
    O.messages_long("hg", T.INFER, "(SELECT * FROM examples ORDER BY idx LIMIT 1)"), "examples"), ("OS4",))


def _shards(spark, sf_dir):
    return OR.assign_shard(fx.examples(spark, sf_dir).select("idx"), 8)


SHARD_SQL = ("SELECT idx, CAST(CASE WHEN n // 8 = 0 THEN 7 ELSE least(idx // (n // 8), 7) END AS INT) AS shard "
             "FROM examples, (SELECT count(*) AS n FROM examples)")
add("sh1_assign_shard_8", _shards, fx.with_fixtures(SHARD_SQL, "examples"), ("SH1", "AG4"))
add("sh2_select_shard_3", lambda spark, sf_dir: OR.select_shard(_shards(spark, sf_dir), 3),
    fx.with_fixtures(f"SELECT * FROM ({SHARD_SQL}) WHERE shard = 3", "examples"), ("SH2",))


def _merge(spark, sf_dir):
    """SO1 on shard tables: position inside each shard, then shard offsets."""
    sh = _shards(spark, sf_dir)
    within = OR.with_position(sh, ["idx"], partition_by=["shard"], name="pos")
    return OR.merge_shards(within, "shard", "pos", "merged_idx").select("idx", "shard", "merged_idx")


add("so1_merge_shard_tables", _merge, fx.with_fixtures(
    f"SELECT idx, shard, CAST(row_number() OVER (ORDER BY shard, idx) - 1 AS BIGINT) AS merged_idx FROM ({SHARD_SQL})",
    "examples"), ("SO1", "WN1"))


# ---------------------------------------------------------------------------
# AG1 / AG2 / AG4 / UD2
# ---------------------------------------------------------------------------
def _tok_count_sql(expr):
    return f"len(regexp_extract_all({expr}, '{TOKEN_PATTERN}'))"


def _profile(spark, sf_dir):
    m = build_messages(fx.examples(spark, sf_dir), PAIR_TASK, T.TRAIN)
    return length_profile(m)


def _profile_sql():
    user, asst = O.layout(PAIR_TASK, T.TRAIN)
    sys_text = TX.sql_str(T.SYSTEM_TEXTS[(PAIR_TASK, T.TRAIN)])
    return fx.with_fixtures(
        f"SELECT CAST(max({_tok_count_sql(sys_text)}) AS BIGINT) AS max_system_tokens, "
        f"CAST(max({_tok_count_sql(O.content(user))}) AS BIGINT) AS max_user_tokens, "
        f"CAST(max({_tok_count_sql(O.content(asst))}) AS BIGINT) AS max_assistant_tokens FROM examples",
        "examples")


add("ag1_length_profile", _profile, _profile_sql(), ("AG1", "UD2"))


def _pair_profile(spark, sf_dir):
    return pair_length_profile(_templated(spark, sf_dir))


add("ag2_pair_length_profile", _pair_profile, fx.with_fixtures(
    f"SELECT CAST(max({_tok_count_sql('prompt')}) AS BIGINT) AS max_prompt_tokens, "
    f"CAST(greatest(max({_tok_count_sql('prompt || chosen')}), max({_tok_count_sql('prompt || rejected')})) "
    f"AS BIGINT) AS max_pair_tokens FROM ({TEMPLATED_SQL})", "pairs"), ("AG2", "UD2"))


def _counts(spark, sf_dir):
    ex = fx.examples(spark, sf_dir)
    pr = fx.pairs(spark, sf_dir)
    return ex.agg(F.count(F.lit(1)).alias("n_examples")).withColumn(
        "n_pairs", pr.select(F.count(F.lit(1))).scalar())


add("ag4_row_counts", _counts, fx.with_fixtures(
    "SELECT (SELECT count(*) FROM examples) AS n_examples, (SELECT count(*) FROM pairs) AS n_pairs",
    "examples", "pairs"), ("AG4",))


def _doc_tokens(spark, sf_dir):
    from ..functions.tokens import token_count
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", token_count("text").cast("bigint").alias("n_tokens"))


add("ud2_token_counts", _doc_tokens,
    f"SELECT doc_id, CAST({_tok_count_sql('text')} AS BIGINT) AS n_tokens FROM documents", ("UD2",))


# ---------------------------------------------------------------------------
# AG3 / AG5 / XP1
# ---------------------------------------------------------------------------
def _overlap_tokens_sql(expr):
    t = f"trim(trim({expr}, {O.WS}), '\"')"
    for pat, rep in CONTRACTION_RULES:
        duck_pat = pat.replace("(?=\\s)", "(\\s)")
        duck_rep = rep.replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3")
        if "(?=\\s)" in pat:
            duck_rep += "\\3"
        t = f"regexp_replace({t}, '{duck_pat.replace(chr(39), chr(39) * 2)}', '{duck_rep.replace(chr(39), chr(39) * 2)}', 'g')"
    t = f"regexp_replace(lower({t}), '{OVERLAP_SEPARATOR}', ' ', 'g')"
    return f"list_filter(string_split({t}, ' '), lambda x: x <> '')"


def _rouge_sql(src, keys, hyp, ref, stem=False):
    kl = ", ".join(keys)
    tokens = "raw_toks" if stem else "toks"
    stemmed = f"""
{STEM_SQL},
toks AS (SELECT {kl}, side, coalesce(stem, tok) AS tok FROM raw_toks LEFT JOIN stems USING (tok)),""" if stem else ""
    return f"""
{tokens} AS (
  SELECT {kl}, 0 AS side, unnest({_overlap_tokens_sql(hyp)}) AS tok FROM {src}
  UNION ALL
  SELECT {kl}, 1 AS side, unnest({_overlap_tokens_sql(ref)}) AS tok FROM {src}),{stemmed}
per_tok AS (SELECT {kl}, tok, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS h,
                   sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS r FROM toks GROUP BY ALL),
per_row AS (SELECT {kl}, sum(least(h, r)) AS o, sum(h) AS nh, sum(r) AS nr FROM per_tok GROUP BY ALL),
scored AS (
  SELECT {", ".join("s." + k for k in keys)}, CAST(coalesce(o, 0) AS BIGINT) AS overlap,
         CAST(coalesce(nh, 0) AS BIGINT) AS n_hyp, CAST(coalesce(nr, 0) AS BIGINT) AS n_ref,
         coalesce(o, 0) / greatest(coalesce(nh, 0), 1) AS p, coalesce(o, 0) / greatest(coalesce(nr, 0), 1) AS rc
  FROM {src} s LEFT JOIN per_row USING ({kl}))"""


# Porter's steps for SQL, in the letters of the published description: a shape of
# C and V per word (y is V after C), the measure m as the count of "VC" in it. One
# row per distinct token; each step is a table.
def _shape_sql(w):
    """C/V shape: y's are settled from left to right, alternately inside a run of y's."""
    plain = f"translate({w}, 'aeiou', 'VVVVV')"
    return (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({plain}, '(^|V)y', '\\1C', 'g'), "
            f"'([^Vy])yy', '\\1VC', 'g'), 'y', 'V', 'g'), '[^V]', 'C', 'g')")


def _m_sql(w):
    return f"len(regexp_extract_all({_shape_sql(w)}, 'V+C'))"


def _cvc_sql(w):
    return f"(({_shape_sql(w)} LIKE '%CVC' AND right({w}, 1) NOT IN ('w', 'x', 'y')) OR {_shape_sql(w)} = 'VC')"


def _cut_sql(n):
    return f"left(w, len(w) - {n})"


def _swap_sql(rules, least=0):
    """CASE branches: the longest suffix that fits decides, and only if m is above ``least``."""
    out = []
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        stem = _cut_sql(len(suffix))
        extra = f" AND right({stem}, 1) IN ('s', 't')" if suffix == "ion" else ""
        out.append(f"WHEN suffix(w, '{suffix}') THEN CASE WHEN {_m_sql(stem)} > {least}{extra} "
                   f"THEN {stem} || '{new}' ELSE w END")
    return "\n".join(out)


# The suffix tables of the published algorithm (with bli, fulli and
# the irregular forms of the widely used implementation), as the SQL has them.
_SQL_STEP2 = ("ational ate,tional tion,enci ence,anci ance,izer ize,bli ble,alli al,entli ent,eli e,ousli ous,"
              "ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,"
              "biliti ble,fulli ful")
_SQL_STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
_SQL_STEP4 = "al,ance,ence,er,ic,able,ible,ant,ement,ment,ent,ion,ou,ism,ate,iti,ous,ive,ize"
_SQL_IRREGULAR = ("skies sky,sky sky,dying die,lying lie,tying tie,news news,innings inning,inning inning,outings outing,"
                  "outing outing,cannings canning,canning canning,howe howe,proceed proceed,exceed exceed,succeed succeed")


def _stem_sql():
    pairs = lambda text: [tuple(x.split(" ")) for x in text.split(",")]
    whens = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs(_SQL_IRREGULAR))
    return f"""
words AS (SELECT DISTINCT tok, tok AS w FROM raw_toks WHERE len(tok) > 3),
s1a AS (SELECT tok, CASE
  WHEN suffix(w, 'ies') AND len(w) = 4 THEN {_cut_sql(1)}
  WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN {_cut_sql(2)}
  WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN {_cut_sql(1)} ELSE w END AS w FROM words),
s1b AS (SELECT tok, CASE
  WHEN suffix(w, 'ied') THEN CASE WHEN len(w) = 4 THEN {_cut_sql(1)} ELSE {_cut_sql(2)} END
  WHEN suffix(w, 'eed') THEN CASE WHEN {_m_sql(_cut_sql(3))} > 0 THEN {_cut_sql(1)} ELSE w END
  WHEN suffix(w, 'ed') AND contains({_shape_sql(_cut_sql(2))}, 'V') THEN {_cut_sql(2)}
  WHEN suffix(w, 'ing') AND contains({_shape_sql(_cut_sql(3))}, 'V') THEN {_cut_sql(3)} ELSE w END AS w,
  CASE WHEN suffix(w, 'ied') OR suffix(w, 'eed') THEN false
  WHEN suffix(w, 'ed') THEN contains({_shape_sql(_cut_sql(2))}, 'V')
  WHEN suffix(w, 'ing') THEN contains({_shape_sql(_cut_sql(3))}, 'V') ELSE false END AS bare FROM s1a),
s1m AS (SELECT tok, CASE WHEN NOT bare THEN w
  WHEN suffix(w, 'at') OR suffix(w, 'bl') OR suffix(w, 'iz') THEN w || 'e'
  WHEN len(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND suffix({_shape_sql('w')}, 'C')
       AND right(w, 1) NOT IN ('l', 's', 'z') THEN {_cut_sql(1)}
  WHEN {_m_sql('w')} = 1 AND {_cvc_sql('w')} THEN w || 'e' ELSE w END AS w FROM s1b),
s1c AS (SELECT tok, CASE WHEN suffix(w, 'y') AND len(w) > 2 AND suffix({_shape_sql(_cut_sql(1))}, 'C')
  THEN {_cut_sql(1)} || 'i' ELSE w END AS w FROM s1m),
s2a AS (SELECT tok, CASE WHEN suffix(w, 'alli') AND {_m_sql(_cut_sql(4))} > 0 THEN {_cut_sql(2)} ELSE w END AS w FROM s1c),
s2 AS (SELECT tok, CASE
  WHEN suffix(w, 'logi') THEN CASE WHEN {_m_sql(_cut_sql(3))} > 0 THEN {_cut_sql(1)} ELSE w END
  {_swap_sql(pairs(_SQL_STEP2))} ELSE w END AS w FROM s2a),
s3 AS (SELECT tok, CASE {_swap_sql(pairs(_SQL_STEP3))} ELSE w END AS w FROM s2),
s4 AS (SELECT tok, CASE {_swap_sql([(x, '') for x in _SQL_STEP4.split(',')], 1)} ELSE w END AS w FROM s3),
s5a AS (SELECT tok, CASE WHEN suffix(w, 'e') AND ({_m_sql(_cut_sql(1))} > 1 OR {_m_sql(_cut_sql(1))} = 1
  AND NOT {_cvc_sql(_cut_sql(1))}) THEN {_cut_sql(1)} ELSE w END AS w FROM s3_4),
stems AS (SELECT tok, CASE tok {whens} ELSE CASE WHEN suffix(w, 'll') AND {_m_sql('w')} > 1
  THEN {_cut_sql(1)} ELSE w END END AS stem FROM s5a)""".replace("FROM s3_4", "FROM s4").strip()


STEM_SQL = _stem_sql()


def _rouge(spark, sf_dir):
    return rouge1(fx.rouge_pairs(spark, sf_dir), "hyp", "ref", "pair_id")


def _rouge_query_sql(stem):
    return ("WITH " + ",\n".join(f"{n} AS ({fx.SQL[n]}\n)" for n in ["rouge_pairs"]) + ","
            + _rouge_sql("rouge_pairs", ["pair_id"], "hyp", "ref", stem)
            + "\nSELECT pair_id, overlap, n_hyp, n_ref, round(p, 6) AS precision, round(rc, 6) AS recall, "
            "round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS f1 FROM scored")


add("ag3_rouge1", _rouge, _rouge_query_sql(False), ("AG3", "JN4", "SC13", "SC3"))

add("ag3_rouge1_stemmed", lambda spark, sf_dir: rouge1(fx.rouge_pairs(spark, sf_dir), stem=True), _rouge_query_sql(True),
    ("AG3", "SC14"))


def _accuracy(spark, sf_dir):
    return number_accuracy(fx.predictions(spark, sf_dir), fx.gold(spark, sf_dir))


add("ag5_number_accuracy", _accuracy, fx.with_fixtures(
    f"SELECT num_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_correct, "
    f"round(sum(CASE WHEN ok THEN 1 ELSE 0 END) / count(*), 6) AS accuracy FROM ("
    f"SELECT g.num_type, coalesce(len(regexp_extract_all(p.text, '{PAT}')) = 1 AND "
    f"replace(regexp_extract_all(p.text, '{PAT}')[1], ',', '') = g.gt, false) AS ok "
    f"FROM gold g LEFT JOIN predictions p ON g.idx = p.idx) GROUP BY ROLLUP (num_type)",
    "gold", "predictions"), ("AG5",))


def _by_gap(spark, sf_dir):
    c = fx.candidates(spark, sf_dir)
    scored = rouge1(c, "candidate", "ref", ["idx", "rep"], keep=("candidate", "ref"))
    return pairs_by_gap(scored.withColumnRenamed("f1", "score"), 0.05)


def _by_gap_sql():
    body = _rouge_sql("candidates", ["idx", "rep"], "candidate", "ref")
    return ("WITH " + f"candidates AS ({fx.SQL['candidates']}\n)," + body + """,
f AS (SELECT c.idx, c.rep, c.ref, c.candidate,
             round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS score
      FROM candidates c JOIN scored s ON c.idx = s.idx AND c.rep = s.rep),
g AS (SELECT idx, any_value(ref) AS news,
             arg_max(candidate, score * 1000000 - rep) AS chosen,
             arg_min(candidate, score * 1000000 + rep) AS rejected,
             arg_max(rep, score * 1000000 - rep) AS chosen_rep,
             arg_min(rep, score * 1000000 + rep) AS rejected_rep,
             max(score) AS chosen_score, min(score) AS rejected_score,
             CAST(count(*) AS BIGINT) AS n_candidates FROM f GROUP BY idx)
SELECT * FROM g WHERE chosen_score - rejected_score >= 0.05""")


add("xp1_pairs_by_gap", _by_gap, _by_gap_sql(), ("XP1", "AG3"))


# ---------------------------------------------------------------------------
# TR1 / TR2 / WN3
# ---------------------------------------------------------------------------
def _toks_sql(expr):
    return f"regexp_extract_all({expr}, '{TOKEN_PATTERN}')"


def _word_places_sql(expr, ends=False):
    """Places (from 1) of the first, or last, character of every word: found
    character by character, unlike the operator's array of parts."""
    chars = f"string_split(translate({expr}, {O.WS}, '{' ' * len(WS29)}'), '')"
    beside = "i = len(c) OR c[i + 1] = ' '" if ends else "i = 1 OR c[i - 1] = ' '"
    return (f"(SELECT list_filter(range(1, len(c) + 1), lambda i: c[i] <> ' ' AND ({beside})) "
            f"FROM (SELECT {chars} AS c))")


def _trunc(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    from ..functions.tokens import token_count
    return d.select("doc_id", token_count("text").cast("bigint").alias("n_tokens"),
                    truncate_left("text", 512).alias("text"))


add("tr1_truncate_left_512", _trunc,
    f"SELECT doc_id, CAST(len(p) AS BIGINT) AS n_tokens, "
    f"CASE WHEN len(p) > 512 THEN substr(text, p[len(p) - 511]) ELSE text END AS text "
    f"FROM (SELECT doc_id, text, {_word_places_sql('text')} AS p FROM documents)", ("TR1",))


def _trunc_ids(spark, sf_dir):
    tokens = utf8_tokens()
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", tokens.count("text").cast("bigint").alias("n_tokens"),
        truncate_left("text", 512, tokens).alias("text"))


def _last_bytes_sql(text, n):
    """Shortest suffix of at least n bytes (a cut character stays whole)."""
    return (f"right({text}, list_filter(range({n} // 4, {n} + 1), "
            f"lambda k: strlen(right({text}, k)) >= {n})[1])")


def _first_bytes_sql(text, n):
    return (f"left({text}, list_filter(range({n} // 4, {n} + 1), "
            f"lambda k: strlen(left({text}, k)) >= {n})[1])")


add("tr1_truncate_left_ids_512", _trunc_ids,
    f"SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_tokens, CASE WHEN strlen(text) > 512 THEN "
    f"{_last_bytes_sql('text', 512)} ELSE text END AS text FROM documents", ("TR1", "UD2"))

_FIT_COLUMNS = ("pair_id", "prompt_tokens", "chosen_tokens", "rejected_tokens", "prompt", "chosen", "rejected")


def _fit(spark, sf_dir):
    return fit_pair(_templated(spark, sf_dir), 1024, 1536).select(*_FIT_COLUMNS)


def _budget_sql(counted, max_prompt, max_length, last, first):
    """Only texts that lose tokens are cut; the others are the input's. ``counted``
    has the counts p, c, r beside the texts; last/first cut a text."""
    keep = max_length - max_prompt
    cut = lambda t, n: f"CASE WHEN still AND {n} > {keep} THEN {first(t, keep)} ELSE {t} END AS {t}"
    return f"""
SELECT pair_id, CAST(np AS BIGINT) AS prompt_tokens,
       CAST(CASE WHEN still THEN least(c, {keep}) ELSE c END AS BIGINT) AS chosen_tokens,
       CAST(CASE WHEN still THEN least(r, {keep}) ELSE r END AS BIGINT) AS rejected_tokens,
       CASE WHEN np < p THEN {last('prompt', max_prompt)} ELSE prompt END AS prompt,
       {cut('chosen', 'c')}, {cut('rejected', 'r')}
FROM (
  SELECT *, np + greatest(c, r) > {max_length} AS still FROM (
    SELECT *, CASE WHEN p + greatest(c, r) > {max_length} THEN least(p, {max_prompt}) ELSE p END AS np
    FROM ({counted})))"""


def _fit_sql_body():
    places = (f"{_word_places_sql('prompt')} AS ps, {_word_places_sql('chosen', True)} AS cs, "
              f"{_word_places_sql('rejected', True)} AS rs")
    return _budget_sql(
        f"SELECT *, len(ps) AS p, len(cs) AS c, len(rs) AS r FROM (SELECT *, {places} FROM ({TEMPLATED_SQL}))", 1024, 1536,
        lambda t, n: f"substr({t}, ps[p - {n} + 1])", lambda t, n: f"left({t}, {t[0]}s[{n}])")


add("tr2_fit_pair", _fit, fx.with_fixtures(_fit_sql_body(), "pairs"), ("TR2",))


def _fit_ids(spark, sf_dir):
    return fit_pair(_templated(spark, sf_dir), 1024, 1536, tokens=utf8_tokens()).select(*_FIT_COLUMNS)


add("tr2_fit_pair_ids", _fit_ids, fx.with_fixtures(_budget_sql(
    f"SELECT *, strlen(prompt) AS p, strlen(chosen) AS c, strlen(rejected) AS r FROM ({TEMPLATED_SQL})", 1024, 1536,
    _last_bytes_sql, _first_bytes_sql), "pairs"), ("TR2", "UD2"))


def _pack(spark, sf_dir):
    return pack(_render_full(spark, sf_dir), "text", ["idx"], 2048).select(
        "block_id", "n_tokens", F.array_join("tokens", " ").alias("text"))


def _pack_sql(tokens):
    """``tokens``: SQL for the token list of the column text."""
    return fx.with_fixtures(f"""
SELECT CAST(block_id AS BIGINT) AS block_id, CAST(count(*) AS BIGINT) AS n_tokens,
       string_agg(tok, ' ' ORDER BY g) AS text
FROM (
  SELECT tok, g, g // 2048 AS block_id FROM (
    SELECT tok, row_number() OVER (ORDER BY idx, i) - 1 AS g FROM (
      SELECT idx, unnest(t) AS tok, generate_subscripts(t, 1) AS i
      FROM (SELECT idx, {tokens} AS t FROM ({_render_full_sql()})))))
GROUP BY block_id HAVING count(*) = 2048""", "examples")


add("wn3_pack_2048", _pack, _pack_sql(_toks_sql("text")), ("WN3",))


def _pack_ids(spark, sf_dir):
    return pack(_render_full(spark, sf_dir), "text", ["idx"], 2048, tokens=utf8_tokens()).select(
        "block_id", "n_tokens", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("text"))


add("wn3_pack_ids_2048", _pack_ids, _pack_sql(
    "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST(CAST('0x' || h AS INTEGER) + 3 AS VARCHAR))"),
    ("WN3", "UD2"))


# ---------------------------------------------------------------------------
# SK1 / SK2 / SK3 / SR4 / SO1 over files: write outputs by shard, read back
# ---------------------------------------------------------------------------
from ..sources import files as S  # noqa: E402
from ..sources import sinks as K  # noqa: E402


def _outputs(spark, sf_dir):
    """Stage-1 style outputs keyed by example, with their shard."""
    return OR.assign_shard(fx.examples(spark, sf_dir).select("idx", F.col("news").alias("text")), 8)


def _sk1(spark, sf_dir):
    path = scratch_path(spark, "sk1-json")
    S.write_outputs(_outputs(spark, sf_dir), path, "json")
    return S.read_outputs(spark, path, "json")


add("sk1_write_read_json_shards", _sk1, fx.with_fixtures(
    f"SELECT s.idx, s.shard, e.news AS text FROM ({SHARD_SQL}) s JOIN examples e ON e.idx = s.idx", "examples"),
    ("SK1",))


def _sk2(spark, sf_dir):
    path = scratch_path(spark, "sk2-txt")
    S.write_outputs(_outputs(spark, sf_dir), path, "txt")
    return S.read_outputs(spark, path, "txt")


add("sk2_so1_write_read_line_shards", _sk2, fx.with_fixtures(
    f"SELECT s.idx, s.shard, trim(replace(e.news, chr(10), ' '), {O.WS}) AS text "
    f"FROM ({SHARD_SQL}) s JOIN examples e ON e.idx = s.idx", "examples"), ("SK2", "SO1", "SR4", "SC6"))


def _sk3(spark, sf_dir):
    path = scratch_path(spark, "sk3-merged")
    S.write_merged(_outputs(spark, sf_dir), path, "txt")
    return S.read_lines(spark, path, pos="idx")


add("sk3_merged_lines", _sk3, fx.with_fixtures(
    f"SELECT idx, trim(replace(news, chr(10), ' '), {O.WS}) AS text FROM examples", "examples"),
    ("SK3", "SR4"))


# ---------------------------------------------------------------------------
# The same row-local operators on a stream of the documents table
# ---------------------------------------------------------------------------
def _stream(spark, sf_dir):
    from ..streaming.rows import stream_through
    schema = fx.table(spark, sf_dir, "documents").schema

    def transform(docs):
        ex = docs.select(F.col("doc_id").alias("idx"), F.col("text").alias("news"),
                         F.split_part("text", F.lit("."), F.lit(1)).alias("headline"))
        m = build_messages(ex, "hg", T.INFER)
        return m.select("idx", render(prompt_messages("messages"), add_generation_prompt=True).alias("prompt"))

    import os
    table_path = f"{sf_dir.rstrip('/')}/documents.parquet"
    if os.path.isdir(table_path):   # a table stored as a folder of part files
        sink = stream_through(spark, table_path, schema, transform)
    else:                           # a single file: stream its folder, filtered by name
        sink = stream_through(spark, sf_dir, schema, transform, glob="documents.parquet")
    return spark.read.parquet(sink)


add("st1_stream_render_prompts", _stream,
    fx.with_fixtures(_prompt_sql("hg", T.INFER), "examples"), ("PJ1", "PJ2", "PJ3"))


# ---------------------------------------------------------------------------
# SC1-SC12 together over whole documents
# ---------------------------------------------------------------------------
def _scalars(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    first = F.split_part("text", F.lit("."), F.lit(1))
    return d.select(
        "doc_id",
        TX.to_text(F.when(d.doc_id % 2 == 0, d.n_chars)).alias("n_chars_text"),               # SC1
        F.char_length(TX.full_strip("text")).cast("bigint").alias("stripped_chars"),          # SC2, SC7
        TX.strip_quotes(F.concat(F.lit(' "'), first, F.lit('" '))).alias("unquoted"),         # SC3, SC4
        TX.numeral_count("text").cast("bigint").alias("n_numerals"),                          # SC5, SC10
        F.md5(TX.flatten_newlines("text")).alias("flat_md5"),                                 # SC6
        F.md5(TX.suffix_from("text", 10)).alias("suffix_md5"),                                # SC8
        F.col("text").contains("the").alias("has_the"),                                       # SC9
        F.size(F.split("text", " ")).cast("bigint").alias("n_space_parts"),                   # SC10
        F.array_join(F.slice(F.split("text", " "), 2, 3), "|").alias("words_2_to_4"),         # SC11
        F.greatest(d.n_chars, F.char_length("text").cast("bigint")).alias("max_len"),         # SC12
    )


add("sc_scalar_functions", _scalars, f"""
SELECT doc_id,
       coalesce(CAST(CASE WHEN doc_id % 2 = 0 THEN n_chars END AS VARCHAR), 'None') AS n_chars_text,
       CAST(length(trim(text, {O.WS})) AS BIGINT) AS stripped_chars,
       trim(trim(' "' || split_part(text, '.', 1) || '" ', {O.WS}), '"') AS unquoted,
       CAST(len(regexp_extract_all(text, '{PAT}')) AS BIGINT) AS n_numerals,
       md5(replace(text, chr(10), ' ')) AS flat_md5,
       md5(substr(text, 11)) AS suffix_md5,
       contains(text, 'the') AS has_the,
       CAST(len(string_split(text, ' ')) AS BIGINT) AS n_space_parts,
       array_to_string(list_slice(string_split(text, ' '), 2, 4), '|') AS words_2_to_4,
       greatest(n_chars, CAST(length(text) AS BIGINT)) AS max_len
FROM documents""", ("SC1", "SC2", "SC3", "SC4", "SC5", "SC6", "SC7", "SC8", "SC9", "SC10", "SC11", "SC12"))


def _preview_gen(spark, sf_dir):
    m = build_messages(fx.examples(spark, sf_dir), "hg", T.INFER)
    out = G.preview_generate(m, G.echo_model, 5, num_check=True)
    return out.select("idx", "user", "ground_truth", "generated", F.col("attempts").cast("bigint").alias("attempts"))


def _preview_gen_sql():
    user, asst = O.layout("hg", T.INFER)
    inner = _prompt_sql("hg", T.INFER, source="few", keys=f"idx, {O.content(user)} AS user, {O.content(asst)} AS ground_truth")
    return fx.with_fixtures(
        f"SELECT idx, user, ground_truth, CASE WHEN L % 7 <> 0 THEN 'answer ' || (L + L % 4) "
        f"ELSE 'answer ' || L || ' and 20' END AS generated, "
        f"CAST(CASE WHEN L % 7 <> 0 THEN L % 4 ELSE 20 END AS BIGINT) AS attempts "
        f"FROM (SELECT idx, user, ground_truth, length(prompt) AS L FROM ({inner}))",
        "examples", extra={"few": f"SELECT * FROM examples ORDER BY {MD5.format(k='idx')}, idx LIMIT 5"})


add("gn4_preview_generate", _preview_gen, _preview_gen_sql(), ("GN4", "OS3"))


# ---------------------------------------------------------------------------
# End-to-end flows
# ---------------------------------------------------------------------------
from . import flows as FL  # noqa: E402


def _flow_sft(spark, sf_dir):
    out = FL.supervised_examples(fx.examples(spark, sf_dir), "nr", block=1024)
    return out.select("block_id", "n_tokens", F.array_join("tokens", " ").alias("text"))


add("flow_supervised_examples", _flow_sft, fx.with_fixtures(f"""
SELECT CAST(block_id AS BIGINT) AS block_id, CAST(count(*) AS BIGINT) AS n_tokens,
       string_agg(tok, ' ' ORDER BY g) AS text
FROM (
  SELECT tok, g, g // 1024 AS block_id FROM (
    SELECT tok, row_number() OVER (ORDER BY idx, i) - 1 AS g FROM (
      SELECT idx, unnest(t) AS tok, generate_subscripts(t, 1) AS i
      FROM (SELECT idx, {_toks_sql('text')} AS t FROM ({_render_full_sql('nr')})))))
GROUP BY block_id HAVING count(*) = 1024""", "examples"), ("PJ1", "PJ3", "WN3"))


def _flow_pref(spark, sf_dir):
    return FL.preference_sets(fx.pairs(spark, sf_dir), PAIR_TASK).select(
        "pair_id", "split", "prompt_tokens", "chosen_tokens", "rejected_tokens", "prompt", "chosen", "rejected")


def _flow_pref_sql():
    split = (f"SELECT pair_id, CASE WHEN row_number() OVER (ORDER BY {MD5.format(k='pair_id')}, pair_id) <= "
             "ceil(0.02 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM pairs")
    fit = _fit_sql_body()
    return fx.with_fixtures(
        f"SELECT f.*, s.split FROM ({fit}) f JOIN ({split}) s USING (pair_id)", "pairs")


add("flow_preference_sets", _flow_pref, _flow_pref_sql(), ("OS2", "PJ4", "PJ5", "TR2"))

STG1, STG2 = "rationale_hg_stg1_ecnc", "rationale_hg_stg2_ecnc"


def _flow_two_stage(spark, sf_dir):
    return FL.two_stage_inference(fx.examples(spark, sf_dir), STG1, STG2, G.echo_model, k=2, num_check=True)


def _flow_two_stage_sql():
    s1 = _prompt_sql(STG1, T.INFER)
    stage1 = (f"SELECT idx, CASE WHEN L % 7 <> 0 AND L % 4 = 0 THEN 'answer ' || L ELSE 'answer ' || L || ' and 0' END "
              f"AS rationale FROM (SELECT idx, length(prompt) AS L FROM ({s1}))")
    src = f"(SELECT e.*, s.rationale AS rationale_hg_stg1 FROM examples e JOIN ({stage1}) s ON e.idx = s.idx)"
    s2 = _prompt_sql(STG2, T.INFER, source=src, keys="idx, rationale_hg_stg1 AS rationale")
    return fx.with_fixtures(
        "SELECT idx, CAST(rep AS BIGINT) AS rep, CASE WHEN L % 7 <> 0 THEN 'answer ' || (L + L % 4) "
        "ELSE 'answer ' || L || ' and 20' END AS text, rationale "
        f"FROM (SELECT idx, rationale, length(prompt) AS L FROM ({s2})), (SELECT unnest(range(2)) AS rep)",
        "examples")


add("flow_two_stage_inference", _flow_two_stage, _flow_two_stage_sql(), ("GN3", "GN4", "JN3", "GN1", "GN2", "PJ7"))


def _flow_gap(spark, sf_dir):
    return FL.gap_pairs_templated(fx.candidates(spark, sf_dir), "hg", 0.05).select(
        "idx", F.col("chosen_rep").cast("bigint").alias("chosen_rep"),
        F.col("rejected_rep").cast("bigint").alias("rejected_rep"), "prompt", "chosen", "rejected")


def _flow_gap_sql():
    sys_text = TX.sql_str(T.SYSTEM_TEXTS[("hg", T.TRAIN)])
    prompt = (O.chatml([("'system'", sys_text)]) + " || " +
              O.chatml([("'user'", "'news: ' || " + O.to_text("news"))], True))
    eos = f"'{IM_END}' || chr(10)"
    return (f"SELECT idx, CAST(chosen_rep AS BIGINT) AS chosen_rep, CAST(rejected_rep AS BIGINT) AS rejected_rep, "
            f"{prompt} AS prompt, {O.to_text('chosen')} || {eos} AS chosen, "
            f"{O.to_text('rejected')} || {eos} AS rejected FROM ({_by_gap_sql()})")


add("flow_gap_pairs_templated", _flow_gap, _flow_gap_sql(), ("XP1", "AG3", "PJ4", "PJ5"))


# ---------------------------------------------------------------------------
# SR1 / SR2 over data derived from the tables: write in key order, read back
# ---------------------------------------------------------------------------
_REC_COLS = "idx, news, headline, masked_headline, ans, summary, rationale_hg, rationale_cal, ecnc"


def _sr1(spark, sf_dir):
    path = scratch_path(spark, "sr1-records")
    S.write_records(fx.examples(spark, sf_dir), path)
    return S.read_records(spark, path, fmt="lines").select(*[c.strip() for c in _REC_COLS.split(",")])


add("sr1_records_jsonl_roundtrip", _sr1, fx.with_fixtures(f"SELECT {_REC_COLS} FROM examples", "examples"),
    ("SR1",))


_OUTPUTS_IN_ORDER = fx.with_fixtures(
    "SELECT CAST(row_number() OVER (ORDER BY idx) - 1 AS BIGINT) AS idx, news AS text FROM examples", "examples")


def _sr1_array(spark, sf_dir):
    path = scratch_path(spark, "sr1-array")
    cols = [F.col(f.replace(" ", "_")).alias(f) for f in S.RECORD_FIELDS]
    K.write_json_arrays(fx.examples(spark, sf_dir).select("idx", F.to_json(F.struct(*cols)).alias("record")), path,
                        value="record", raw=True)
    return S.read_records(spark, path).select(*[c.strip() for c in _REC_COLS.split(",")])


add("sr1_records_array", _sr1_array, fx.with_fixtures(f"SELECT {_REC_COLS} FROM examples", "examples"), ("SR1",))


def _sr1_mixed(spark, sf_dir):
    """One field holds booleans, texts that spell booleans, numbers and nulls."""
    path = scratch_path(spark, "sr1-mixed")
    kind = F.pmod("doc_id", F.lit(5))
    ecnc = (F.when(kind == 0, "true").when(kind == 1, '"true"').when(kind == 2, "false").when(kind == 3, "null")
            .otherwise(F.concat("doc_id", F.lit(".50"))))
    line = F.concat(F.lit('{"news": '), K.json_string("text"), F.lit(', "ecnc": '), ecnc, F.lit("}"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (fx.table(spark, sf_dir, "documents").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
     .select(line.alias("value")).write.text(path))
    return S.read_records(spark, path, fmt="lines").select("idx", "news", "ecnc")


add("sr1_mixed_types", _sr1_mixed, """
SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx, text AS news,
       CASE doc_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN 'true' WHEN 2 THEN 'False' WHEN 4 THEN doc_id || '.5' END AS ecnc
FROM documents""", ("SR1", "SC1"))


def _sr3(spark, sf_dir):
    path = scratch_path(spark, "sr3-strings")
    K.write_json_arrays(_outputs(spark, sf_dir), path)
    return S.read_string_list(spark, path, pos="idx")


add("sr3_string_list", _sr3, _OUTPUTS_IN_ORDER, ("SR3", "SC15", "SK1"))


def _rank_files(spark, sf_dir):
    path = scratch_path(spark, "rank-files")
    K.write_json_arrays(_outputs(spark, sf_dir), path)
    return S.read_rank_files(spark, path, "json")


add("so1_rank_files", _rank_files, _OUTPUTS_IN_ORDER, ("SO1", "SK1"))


def _sr2_arrow(spark, sf_dir):
    path = scratch_path(spark, "sr2-arrow")
    K.write_arrow_shards(fx.pairs(spark, sf_dir).select("pair_id", "news", "chosen", "rejected"), path, "pair_id")
    return S.read_pairs(spark, path).select("idx", "news", "chosen", "rejected")


add("sr2_pairs_arrow_shards", _sr2_arrow, fx.with_fixtures(
    "SELECT CAST(row_number() OVER (ORDER BY pair_id) - 1 AS BIGINT) AS idx, news, chosen, rejected FROM pairs",
    "pairs"), ("SR2",))


def _sr2(spark, sf_dir):
    path = scratch_path(spark, "sr2-pairs")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (fx.pairs(spark, sf_dir).repartitionByRange(n, "pair_id").sortWithinPartitions("pair_id")
     .select("news", "chosen", "rejected").write.option("compression", "zstd").parquet(path))
    return S.read_pairs(spark, path).select("idx", "news", "chosen", "rejected")


add("sr2_pairs_parquet_roundtrip", _sr2, fx.with_fixtures(
    "SELECT CAST(row_number() OVER (ORDER BY pair_id) - 1 AS BIGINT) AS idx, news, chosen, rejected FROM pairs",
    "pairs"), ("SR2",))
