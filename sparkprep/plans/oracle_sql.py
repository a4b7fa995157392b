"""Helpers that spell the library's column rules in DuckDB SQL for the oracles."""

from __future__ import annotations

import re

from ..functions.text import NULL_TEXT, ws_sql, sql_str
from ..operators import templates as T
from ..operators.messages import IM_END, IM_START

WS = ws_sql()


def to_text(col: str) -> str:
    return f"coalesce(CAST({col} AS VARCHAR), '{NULL_TEXT}')"


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


# The layouts of user and assistant contents once more, written out for
# the oracles apart from the operator's table. {x} is a stripped column, {x!} one as
# it is, ~ a line break. Lines: tasks: training user | assistant, and where
# inference differs: inference user | assistant.
LAYOUTS = """
hg: news: {news} | {headline}
rationale_hg_stg1_cal: news: {news} | calculation: {rationale_cal}
rationale_hg_stg1_cal inference: news: {news} | calculation: {rationale_cal!}
rationale_hg_stg1_emp: news: {news} | focus: {rationale_hg}
rationale_hg_stg1_ec: news: {news} | summary: {summary} focus: {rationale_hg} calculation: {rationale_cal!}
rationale_hg_stg1_ecnc: news: {news} | {ecnc}
rationale_hg_stg2_cal: news: {news} calculation: {rationale_cal} | {headline}
rationale_hg_stg2_cal inference: news: {news} {rationale_hg_stg1} | {headline}
rationale_hg_stg2_emp: news: {news} focus: {rationale_hg} | {headline}
rationale_hg_stg2_emp inference: news: {news} {rationale_hg_stg1} | {headline}
rationale_hg_stg2_ec: news: {news} summary: {summary} focus: {rationale_hg} calculation: {rationale_cal!} | {headline}
rationale_hg_stg2_ec inference: news: {news} {rationale_hg_stg1} | {headline}
rationale_hg_stg2_ecnc: news: {news}~~{ecnc!} | {headline}
rationale_hg_stg2_ecnc inference: news: {news}~~{rationale_hg_stg1} | {headline}
nr: news: {news} masked headline: {masked_headline} | {ans}
rationale_nr_stg1_ec: news: {news} masked headline: {masked_headline} | summary: {summary} focus: {rationale_hg} calculation: {rationale_cal}
rationale_nr_stg1_ecnc: news: {news} masked headline: {masked_headline} | {ecnc}
rationale_nr_stg2_ec: news: {news} masked headline: {masked_headline} summary: {summary} focus: {rationale_hg} calculation: {rationale_cal} | {ans}
rationale_nr_stg2_ec inference: news: {news} masked headline: {masked_headline} {rationale_nr_stg1} | {ans}
rationale_nr_stg2_ecnc: news: {news}~~{ecnc} | {ans}
rationale_nr_stg2_ecnc inference: news: {news}~~{rationale_nr_stg1} | {ans}
"""
_LAYOUT = {tuple(head.split(" ")): tuple(body.split(" | ")) for head, body in
           (line.split(": ", 1) for line in LAYOUTS.strip().split("\n"))}


def layout(task: str, mode: str) -> tuple[str, str]:
    return _LAYOUT.get((task, mode), _LAYOUT[(task,)])


def content(text: str, alias: str = "") -> str:
    """SQL of a layout text."""
    out = []
    for x in re.split(r"(\{\w+!?\})", text):
        if x[:1] == "{":
            col = alias + x.strip("{}!")
            out.append(to_text(col) if x.endswith("!}") else strip(to_text(col)))
        elif x:
            out.append(sql_str(x.replace("~", "\n")))
    return "(" + " || ".join(out) + ")"


def messages_long(task: str, mode: str, source: str, alias: str = "", keys: str = "idx") -> str:
    """(keys, pos, role, content) rows of PJ1 for one task/mode, as SQL."""
    user, asst = layout(task, mode)
    sys_text = sql_str(T.SYSTEM_TEXTS[(task, mode)])
    rows = [("0", "'system'", sys_text), ("1", "'user'", content(user, alias)),
            ("2", "'assistant'", content(asst, alias))]
    sel = [f"SELECT {keys}, CAST({pos} AS BIGINT) AS pos, {role} AS role, {c} AS content FROM {source}"
           for pos, role, c in rows]
    return "\nUNION ALL\n".join(sel)


def chatml(role_content: list[tuple[str, str]], add_generation_prompt: bool = False) -> str:
    parts = [f"'{IM_START}' || {r} || chr(10) || {c} || '{IM_END}' || chr(10)" for r, c in role_content]
    if add_generation_prompt:
        parts.append(f"'{IM_START}assistant' || chr(10)")
    return "(" + " || ".join(parts) + ")"
