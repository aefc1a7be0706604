"""What the plans of the registered queries must and must not hold."""

import contextlib
import io

import pytest

from quillgraph.plans import catalogue

#: Queries with a step that no built-in function can say: the longest ascending chain.
IN_PYTHON = {"r_master_contents"}


def plan(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if not n.startswith("r_stream")))
def test_no_comparison_of_all_with_all(spark, sf, name):
    text = plan(catalogue.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in IN_PYTHON:
        assert not any(x in text for x in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow"))


@pytest.mark.parametrize("name,parts", [
    ("r_latest_children", ["WindowGroupLimit", "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>"]),
    ("r_first_or_none", ["TakeOrderedAndProject", "EqualTo(o_orderstatus,P)"]),
    ("r_cascade", ["LessThan(c_acctbal,0.0)", "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>", "LeftAnti"]),
    ("r_set_null", ["ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>"]),
    ("r_latest_revision", ["partial_max_by"]),
    ("r_child_count", ["partial_count(1)"]),
    ("r_orphans", ["LessThan(p_size,45)", "LeftAnti"]),
])
def test_pushed_down_and_pruned(spark, sf, name, parts):
    text = plan(catalogue.QUERIES[name](spark, sf))
    for part in parts:
        assert part in text, part
