"""Plan-shape checks: no Python in row-local operators, the template table is
broadcast, and scans are pruned to the columns a query uses."""

import re

from sparkprep.operators import templates as T
from sparkprep.plans import fixtures as fx
from sparkprep.plans.registry import all_queries

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_local_queries_run_without_python(spark):
    qs = all_queries()
    for name, q in qs.items():
        if name.startswith(("pj1_", "pj2", "pj3", "pj4", "pj6", "pj7", "fl1", "sc5", "tr1", "ud2", "ag1")) and "_ids" not in name:
            plan = _plan(q.build(spark, SF))
            assert "EvalPython" not in plan and "PythonUDF" not in plan, name


def test_template_table_is_broadcast(spark):
    plan = _plan(all_queries()["pj6_fl2_task_column"].build(spark, SF))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_scan_prunes_columns(spark):
    df = all_queries()["pj1_hg_train"].build(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # hg needs text (news, headline) and doc_id only
    assert "n_chars" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_rouge_has_no_pairwise_join(spark):
    plan = _plan(all_queries()["ag3_rouge1"].build(spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


PYTHON_OK = ("gn3_", "gn4_", "flow_two_stage", "tr1_truncate_left_ids", "tr2_fit_pair_ids", "wn3_pack_ids")


def _top_lists(s):
    """The top-level [...] groups of a plan line, in order."""
    out, depth, start = [], 0, None
    for i, ch in enumerate(s):
        if ch == "[":
            if depth == 0:
                start = i + 1
            depth += 1
        elif ch == "]" and depth:
            depth -= 1
            if depth == 0:
                out.append(s[start:i])
    return out


def _window_partitioned(line):
    """Window prints [exprs], [partition], [order]; an empty partition list is
    left out, so two lists whose second is an ordering mean no partitioning."""
    lists = _top_lists(line[line.index("Window ["):])
    if len(lists) >= 3:
        return bool(lists[1].strip())
    if len(lists) == 2:
        return not re.search(r"\b(ASC|DESC)\b", lists[1])
    return False


def _all_plans(spark):
    out = {}
    for name, q in all_queries().items():
        df = q.build(spark, SF)
        out[name] = df._jdf.queryExecution().executedPlan().toString()
    return out


def test_all_query_plans(spark):
    for name, plan in _all_plans(spark).items():
        # every Window has a partition spec: "Window [exprs], [partition], [order]"
        for line in plan.split("\n"):
            if "Window [" in line and not _window_partitioned(line):
                raise AssertionError(f"{name}: window without partitioning: {line[:200]}")
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
        if not name.startswith(PYTHON_OK):
            assert "PythonUDF" not in plan and "EvalPython" not in plan and "MapInPandas" not in plan, name


def test_window_line_parser():
    unpart = ("+- Window [row_number() windowspecdefinition(_h#44 ASC NULLS FIRST, specifiedwindowframe(RowFrame, "
              "unboundedpreceding$(), currentrow$())) AS _we0#28], [_h#44 ASC NULLS FIRST]")
    part_no_order = ("+- Window [min(_loc#1L) windowspecdefinition(_pid#11, _g0#25L, specifiedwindowframe(RowFrame, "
                     "unboundedpreceding$(), unboundedfollowing$())) AS _lstart#26L], [_pid#11, _g0#25L]")
    part_order = ("Window [sum(_w#3) windowspecdefinition(_b#37L, idx#2L ASC NULLS FIRST, specifiedwindowframe("
                  "RowFrame, unboundedpreceding$(), -1)) AS _we0#4L], [_b#37L], [idx#2L ASC NULLS FIRST]")
    assert not _window_partitioned(unpart)
    assert _window_partitioned(part_no_order) and _window_partitioned(part_order)
