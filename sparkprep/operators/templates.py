"""The (task, mode) template table and plan-time task routing.

The reference hard-codes one branch per task; here each branch is a row of
data: a system text plus the ordered parts of the user and assistant
contents. Parts are literals or columns, each column either stripped or not.
The prompt wording below is this project's own; callers that need other
wording pass their own ``system_texts`` mapping.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TRAIN = "train"
INFER = "inference"
MODES = (TRAIN, INFER)


@dataclass(frozen=True)
class Col:
    name: str
    strip: bool = True


Part = "str | Col"

# ---------------------------------------------------------------------------
# Message layouts per task. Literal prefixes and separators,
# which columns are used, and whether each column is stripped must match the
# reproduced behaviour exactly. R1/R2 are the stage-1 generated columns.
# ---------------------------------------------------------------------------
NEWS = ["news: ", Col("news")]
MASKED = [" masked headline: ", Col("masked_headline")]
R1 = Col("rationale_hg_stg1")
R2 = Col("rationale_nr_stg1")

# task -> {mode: (user parts, assistant parts)}
LAYOUTS: dict[str, dict[str, tuple[list, list]]] = {
    "hg": {
        TRAIN: (NEWS, [Col("headline")]),
        INFER: (NEWS, [Col("headline")]),
    },
    "rationale_hg_stg1_cal": {
        TRAIN: (NEWS, ["calculation: ", Col("rationale_cal")]),
        INFER: (NEWS, ["calculation: ", Col("rationale_cal", strip=False)]),
    },
    "rationale_hg_stg1_emp": {
        TRAIN: (NEWS, ["focus: ", Col("rationale_hg")]),
        INFER: (NEWS, ["focus: ", Col("rationale_hg")]),
    },
    "rationale_hg_stg1_ec": {
        TRAIN: (NEWS, ["summary: ", Col("summary"), " focus: ", Col("rationale_hg"),
                       " calculation: ", Col("rationale_cal", strip=False)]),
        INFER: (NEWS, ["summary: ", Col("summary"), " focus: ", Col("rationale_hg"),
                       " calculation: ", Col("rationale_cal", strip=False)]),
    },
    "rationale_hg_stg1_ecnc": {
        TRAIN: (NEWS, [Col("ecnc")]),
        INFER: (NEWS, [Col("ecnc")]),
    },
    "rationale_hg_stg2_cal": {
        TRAIN: (NEWS + [" calculation: ", Col("rationale_cal")], [Col("headline")]),
        INFER: (NEWS + [" ", R1], [Col("headline")]),
    },
    "rationale_hg_stg2_emp": {
        TRAIN: (NEWS + [" focus: ", Col("rationale_hg")], [Col("headline")]),
        INFER: (NEWS + [" ", R1], [Col("headline")]),
    },
    "rationale_hg_stg2_ec": {
        TRAIN: (NEWS + [" summary: ", Col("summary"), " focus: ", Col("rationale_hg"),
                        " calculation: ", Col("rationale_cal", strip=False)], [Col("headline")]),
        INFER: (NEWS + [" ", R1], [Col("headline")]),
    },
    "rationale_hg_stg2_ecnc": {
        TRAIN: (NEWS + ["\n\n", Col("ecnc", strip=False)], [Col("headline")]),
        INFER: (NEWS + ["\n\n", R1], [Col("headline")]),
    },
    "nr": {
        TRAIN: (NEWS + MASKED, [Col("ans")]),
        INFER: (NEWS + MASKED, [Col("ans")]),
    },
    "rationale_nr_stg1_ec": {
        TRAIN: (NEWS + MASKED, ["summary: ", Col("summary"), " focus: ", Col("rationale_hg"),
                                " calculation: ", Col("rationale_cal")]),
        INFER: (NEWS + MASKED, ["summary: ", Col("summary"), " focus: ", Col("rationale_hg"),
                                " calculation: ", Col("rationale_cal")]),
    },
    "rationale_nr_stg1_ecnc": {
        TRAIN: (NEWS + MASKED, [Col("ecnc")]),
        INFER: (NEWS + MASKED, [Col("ecnc")]),
    },
    "rationale_nr_stg2_ec": {
        TRAIN: (NEWS + MASKED + [" summary: ", Col("summary"), " focus: ", Col("rationale_hg"),
                                 " calculation: ", Col("rationale_cal")], [Col("ans")]),
        INFER: (NEWS + MASKED + [" ", R2], [Col("ans")]),
    },
    "rationale_nr_stg2_ecnc": {
        TRAIN: (NEWS + ["\n\n", Col("ecnc")], [Col("ans")]),
        INFER: (NEWS + ["\n\n", R2], [Col("ans")]),
    },
}

TASKS = tuple(LAYOUTS)

# ---------------------------------------------------------------------------
# Default system texts (this project's own wording). Keyed by (task, mode);
# three tasks are worded differently for inference, as in the source recipes.
# ---------------------------------------------------------------------------
_NEWS_INTRO = "A news article follows the prefix 'news:'."
_MASK_INTRO = " A headline with its number hidden follows the prefix 'masked headline'."
_HG_GOAL = " Using what is given, write a headline whose number is correct."
_NR_GOAL = " Using what is given, work out the hidden number of the headline."

_SYSTEM_TRAIN = {
    "hg": _NEWS_INTRO + " Write a suitable headline for it that contains a number written in digits.",
    "rationale_hg_stg1_cal": _NEWS_INTRO + " From the article, explain after the prefix 'calculation:' how the headline number is computed.",
    "rationale_hg_stg1_emp": _NEWS_INTRO + " From the article, state after the prefix 'focus:' which facts a headline should centre on.",
    "rationale_hg_stg1_ec": _NEWS_INTRO + " From the article, give a short summary after 'summary:', the facts a headline should centre on after 'focus:', and the computation of the headline number after 'calculation:'.",
    "rationale_hg_stg1_ecnc": _NEWS_INTRO + " From the article, say what the headline should centre on, name every entity in it, name every number in it, and show how the headline number follows from those entities and numbers.",
    "rationale_hg_stg2_cal": _NEWS_INTRO + " An explanation of how the headline number is computed follows 'calculation:'." + _HG_GOAL,
    "rationale_hg_stg2_emp": _NEWS_INTRO + " The facts a headline should centre on follow 'focus:'." + _HG_GOAL,
    "rationale_hg_stg2_ec": _NEWS_INTRO + " A short summary follows 'summary:', the facts to centre on follow 'focus:', and the computation of the headline number follows 'calculation:'." + _HG_GOAL,
    "rationale_hg_stg2_ecnc": _NEWS_INTRO + " A hint on what to centre on, the entities, the numbers and how the headline number follows from them are given after the article." + _HG_GOAL,
    "nr": _NEWS_INTRO + _MASK_INTRO + " From the article, give the hidden number.",
    "rationale_nr_stg1_ec": _NEWS_INTRO + _MASK_INTRO + " From the article, give a short summary after 'summary:', the facts to centre on after 'focus:', and the computation of the hidden number after 'calculation:'.",
    "rationale_nr_stg1_ecnc": _NEWS_INTRO + _MASK_INTRO + " From the article, say what the headline should centre on, name every entity, name every number, and show how the hidden number follows from them.",
    "rationale_nr_stg2_ec": _NEWS_INTRO + _MASK_INTRO + " A short summary follows 'summary:', the facts to centre on follow 'focus:', and the computation of the hidden number follows 'calculation:'." + _NR_GOAL,
    "rationale_nr_stg2_ecnc": _NEWS_INTRO + _MASK_INTRO + " A hint on what to centre on, the entities, the numbers and how the hidden number follows from them are given after the article." + _NR_GOAL,
}
_SYSTEM_INFER_DIFF = {
    "rationale_hg_stg1_cal": _NEWS_INTRO + " From the article, please explain after the prefix 'calculation:' how the headline number is computed.",
    "rationale_nr_stg1_ec": _NEWS_INTRO + _MASK_INTRO + " From the article and the given news, give a short summary after 'summary:', the facts to centre on after 'focus:', and the computation of the hidden number after 'calculation:'.",
    "rationale_nr_stg2_ec": _NEWS_INTRO + _MASK_INTRO + " A short summary follows 'summary:', the facts to centre on follow 'focus:', and the computation of the hidden number follows 'calculation:'.",
}

SYSTEM_TEXTS: dict[tuple[str, str], str] = {
    **{(t, TRAIN): s for t, s in _SYSTEM_TRAIN.items()},
    **{(t, INFER): _SYSTEM_INFER_DIFF.get(t, s) for t, s in _SYSTEM_TRAIN.items()},
}


def check_task(task: str, mode: str = TRAIN) -> None:
    """Fail at plan time for an unknown task or mode."""
    if task not in LAYOUTS:
        raise ValueError(f"unknown task {task!r}; expected one of {', '.join(TASKS)}")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; expected {TRAIN!r} or {INFER!r}")


def layout(task: str, mode: str) -> tuple[list, list]:
    check_task(task, mode)
    return LAYOUTS[task][mode]


def required_columns(task: str, mode: str) -> list[str]:
    user, asst = layout(task, mode)
    seen: list[str] = []
    for p in user + asst:
        if isinstance(p, Col) and p.name not in seen:
            seen.append(p.name)
    return seen


# ---------------------------------------------------------------------------
# FL2: routing by substring of the task name (plan-time and column forms)
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class TaskKind:
    stage: int              # 1 or 2; tasks without a stage tag count as 1
    output_format: str      # "json" for stage-1 tasks, "txt" otherwise
    rationale_column: str | None  # column the stage-1 output is attached as


def task_kind(task: str) -> TaskKind:
    stage = 2 if "stg2" in task else 1
    fmt = "json" if "stg1" in task else "txt"
    if "hg" in task:
        rcol = "rationale_hg_stg1"
    elif "nr" in task:
        rcol = "rationale_nr_stg1"
    else:
        rcol = None
    return TaskKind(stage, fmt, rcol)


def template_table(spark: SparkSession, system_texts: dict | None = None) -> DataFrame:
    """(task, mode, system) as a DataFrame: 14 tasks x 2 modes = 28 rows."""
    texts = system_texts or SYSTEM_TEXTS
    rows = [(t, m, texts[(t, m)]) for t in TASKS for m in MODES]
    return spark.createDataFrame(rows, "task string, mode string, system string")


def route(df: DataFrame, task_col: str = "task") -> DataFrame:
    """FL2 as a column operation: stage, output format and rationale column
    per row, from substrings of the row's task name."""
    from pyspark.sql import functions as F
    t = F.col(task_col)
    return (df.withColumn("stage", F.when(t.contains("stg2"), 2).otherwise(1))
            .withColumn("output_format", F.when(t.contains("stg1"), "json").otherwise("txt"))
            .withColumn("rationale_column",
                        F.when(t.contains("hg"), "rationale_hg_stg1")
                        .when(t.contains("nr"), "rationale_nr_stg1")))
