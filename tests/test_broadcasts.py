"""Tables with a row per entity are not sent to the driver to be broadcast, however small their files look."""

import os

import pytest

SF = os.environ.get("MATCHLOOM_SF", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["implied_class", "evidence_rank"])
def test_queries_broadcast_no_entities(spark, name):
    from matchloom.plans import all_queries
    shown = plan(all_queries().QUERIES[name](spark, SF))
    assert "SortMergeJoin [id" in shown and "BroadcastHashJoin [id" not in shown


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_signals_under_pairs_broadcast_no_entities(spark):
    from matchloom.operators import signals as sg
    from matchloom.plans import all_queries, demo
    all_queries()
    from matchloom.plans.q_signals import RULES, weighted
    shown = plan(sg.extract(demo.people(spark, SF), None, demo.as_of(), RULES, weighted=weighted(spark, SF)))
    assert "SortMergeJoin [id" in shown and "BroadcastHashJoin [id" not in shown
