"""Chat-example construction and rendering (PJ1, PJ2, PJ3, PJ6).

A chat example is ``array<struct<role string, content string>>`` with three
elements: system, user, assistant. Everything is a column expression; Catalyst
prunes the scan to the columns the chosen task names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_part
from . import templates as T

# ---------------------------------------------------------------------------
# ChatML delimiters (the public default chat format).
# ---------------------------------------------------------------------------
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"

# A caller-supplied template table is broadcast only up to this many rows.
_TEMPLATE_BROADCAST_MAX_ROWS = 10_000


def _content(parts: list) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else text_part(p.name, p.strip) for p in parts]
    return cols[0] if len(cols) == 1 else F.concat(*cols)


def message(role, content: Column) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), content.alias("content"))


def messages_column(task: str, mode: str = T.TRAIN, system: Column | str | None = None) -> Column:
    """The three-message array for one task as a Column (PJ1)."""
    user, asst = T.layout(task, mode)
    if system is None:
        system = T.SYSTEM_TEXTS[(task, mode)]
    sys_col = F.lit(system) if isinstance(system, str) else system
    return F.array(message("system", sys_col), message("user", _content(user)),
                   message("assistant", _content(asst)))


def build_messages(df: DataFrame, task: str, mode: str = T.TRAIN, keep=("idx",),
                   system_texts: dict | None = None) -> DataFrame:
    """PJ1: rows -> (keep..., messages). Missing task columns fail at plan time."""
    T.check_task(task, mode)
    missing = [c for c in T.required_columns(task, mode) if c not in df.columns]
    if missing:
        raise ValueError(f"task {task!r} ({mode}) needs columns {missing}")
    texts = system_texts or T.SYSTEM_TEXTS
    return df.select(*keep, messages_column(task, mode, texts[(task, mode)]).alias("messages"))


def prompt_messages(messages) -> Column:
    """PJ2: drop the answer, keep system + user."""
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.slice(m, 1, 2)


def render(messages, add_generation_prompt: bool = False,
           start: str = IM_START, end: str = IM_END, n: int | None = None) -> Column:
    """PJ3: messages -> one prompt string in ChatML-style delimiters.

    With ``n`` (the known number of messages) the string is one ``concat`` of
    the message fields instead of a ``transform`` over the array. The two give
    the same text; measured here, neither is faster in general (the concat
    form was slower feeding the packing step), so the default is the
    general form."""
    m = F.col(messages) if isinstance(messages, str) else messages
    if n is not None:
        parts = []
        for i in range(1, n + 1):
            e = F.element_at(m, i)
            parts += [F.lit(start), e["role"], F.lit("\n"), e["content"], F.lit(end + "\n")]
        body = F.concat(*parts)
    else:
        body = F.array_join(
            F.transform(m, lambda x: F.concat(F.lit(start), x["role"], F.lit("\n"), x["content"],
                                              F.lit(end + "\n"))), "")
    return F.concat(body, F.lit(start + "assistant\n")) if add_generation_prompt else body


def explode_messages(df: DataFrame, keep=("idx",), messages: str = "messages") -> DataFrame:
    """Long form (keep..., pos, role, content): one row per message.

    posexplode_outer: with a plain posexplode the optimizer infers a
    size(messages) > 0 filter and evaluates the whole message array twice."""
    return df.select(*keep, F.posexplode_outer(messages).alias("pos", "m")).where(F.col("pos").isNotNull()).select(
        *keep, F.col("pos").cast("bigint").alias("pos"), F.col("m.role").alias("role"),
        F.col("m.content").alias("content"))


def messages_by_task_column(df: DataFrame, templates: DataFrame, task_col: str = "task",
                            mode: str = T.TRAIN, keep=("idx",)) -> DataFrame:
    """PJ6 when the task is a column: each row picks its layout by its own task.

    The system text comes from the template table through a broadcast join;
    the table has exactly one row per (task, mode), 28 rows in all, so its
    size is fixed and known before the join. User and assistant contents are
    a CASE over the 14 layouts.
    """
    tpl = (templates.filter(F.col("mode") == mode)
           .select(F.col("task").alias("_tpl_task"), F.col("system").alias("_system")))
    if tpl.count() <= _TEMPLATE_BROADCAST_MAX_ROWS:  # one row per task: 14 for the defaults
        tpl = F.broadcast(tpl)
    joined = df.join(tpl, F.col(task_col) == F.col("_tpl_task"), "left")
    user = asst = None
    for task in T.TASKS:
        u, a = T.layout(task, mode)
        if not all(c in df.columns for c in T.required_columns(task, mode)):
            continue
        cond = F.col(task_col) == F.lit(task)
        user = F.when(cond, _content(u)) if user is None else user.when(cond, _content(u))
        asst = F.when(cond, _content(a)) if asst is None else asst.when(cond, _content(a))
    # an unknown task (or one whose columns are missing) fails the job, as an
    # unknown task name fails at plan time when the task is a parameter
    bad = F.raise_error(F.concat(F.lit("unknown task or missing columns for task: "),
                                 F.coalesce(F.col(task_col), F.lit("NULL"))))
    user, asst = user.otherwise(bad.cast("string")), asst.otherwise(bad.cast("string"))
    msgs = F.array(message("system", F.col("_system")), message("user", user),
                   message("assistant", asst))
    return joined.select(*keep, F.col(task_col), msgs.alias("messages"))
