import importlib
import sys

import pytest


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_text_operators(monkeypatch):
    import __spark_entry__ as e

    for name in [n for n in sys.modules if n.startswith("ledgerlens.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ledgerlens.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(e)
    assert len(bare.queries()) >= 70 and not any(n.startswith("op1_") or n == "pipeline" for n in bare.queries())
    monkeypatch.undo()
    importlib.reload(e)


def test_no_cross_joins_in_plans(spark):
    import __spark_entry__ as e

    for name in ("entity_latest", "q_and_or_not", "attr_links", "oplog_decode"):
        plan = e.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["q_content_type", "q_expiration_lt"])
def test_filters_reach_the_scan(spark, name):
    import __spark_entry__ as e

    plan = e.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]
