"""The driver contract in __spark_entry__.py."""

import importlib.util
import os
import re

_PATH = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", _PATH)
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_runs_and_has_stable_schema(spark):
    m = _entry()
    df = m.entry(spark)
    assert df.columns == ["idx", "prompt"] and df.count() > 0
    assert df.schema.simpleString() == m.entry(spark).schema.simpleString()


def test_registry_contract():
    m = _entry()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70
    assert all(callable(f) for f in q.values())
    # the library's own registry leaves the numbered names and the pipeline to the optional part
    from sparkprep.plans.registry import all_queries
    own = all_queries()
    for name in own:
        assert re.fullmatch(r"[a-z0-9_]+", name) and "pipeline" not in name and not re.match(r"op\d+_", name)
    assert set(own) <= set(q)
    assert all(n == "pipeline" or re.match(r"op\d+_", n) for n in set(q) - set(own))
