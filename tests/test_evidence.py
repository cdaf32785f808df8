"""Joins matched to plan nodes."""

import pytest

from querytide.operators import evidence

JOIN = "query_id int, join_no int, condition string, left_physical_sources string"
NODE = "query_id int, plan_node_id int, child_query_sequence int, plan_parent_id int, plan_node string, plan_info string"
STEP = "query_id int, plan_node_id int, child_query_sequence int, step_id int, step_name string, output_rows long, data_skewness int"


def matched(spark, joins, nodes, steps=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return {(r.query_id, r.join_no): r for r in evidence.plan_evidence(frame(joins, JOIN), frame(nodes, NODE), frame(steps, STEP)).collect()}


def test_conditions_and_physical_tables_decide_and_ties_take_the_first(spark):
    nodes = [(1, 5, 0, 1, "XN Hash Join DS_BCAST_INNER", "Hash Cond: (a.id = b.id)"), (1, 4, 0, 1, "XN Hash Join DS_DIST_BOTH on sales", ""), (1, 3, 1, 1, "XN Hash Join", "Hash  Cond: (a.id  =  b.id)"), (1, 2, 0, 1, "XN Seq Scan on a", "Filter: (a.id = b.id)")]
    joins = [(1, 1, "(A.id = b.id)", None), (1, 2, "zz = yy", "db.sales.id"), (1, 3, "nothing", "")]
    got = matched(spark, joins, nodes)
    assert (got[1, 1].plan_node_id, got[1, 1].plan_match_status, got[1, 1].actual_movement) == (5, "Matched (high)", "DS_BCAST_INNER"), "scans are no candidates, and of equal nodes the first sequence counts"
    assert (got[1, 2].plan_node_id, got[1, 2].plan_match_confidence, got[1, 2].plan_operator) == (4, "medium", "XN Hash Join DS_DIST_BOTH on sales")
    assert (got[1, 3].plan_node_id, got[1, 3].plan_match_status, got[1, 3].actual_movement) == (None, evidence.UNRESOLVED, "")


def test_one_join_and_one_node_need_no_score(spark):
    got = matched(spark, [(1, 1, "q = r", ""), (2, 1, "q = r", ""), (2, 2, "", "")], [(1, 1, None, None, "XN Nested Loop", None), (2, 1, None, None, "XN Merge Join", None)])
    assert got[1, 1].plan_match_status == "Matched (single-join inference)" and got[1, 1].actual_movement == evidence.NO_MOVEMENT
    assert got[2, 1].plan_match_status == got[2, 2].plan_match_status == evidence.UNRESOLVED
    assert matched(spark, [(3, 1, "x", "")], [])[3, 1].plan_match_status == evidence.NO_PLAN


@pytest.mark.parametrize(("sequence", "rows", "names"), [(1, 30.0, "scan, join"), (None, 70.0, "scan, join, sort"), (7, 0.0, "")])
def test_steps_meet_by_node_and_sequence(spark, sequence, rows, names):
    steps = [(1, 9, 1, 2, "join", 20, 3), (1, 9, 1, 1, "scan", 10, None), (1, 9, 2, 3, "sort", 40, 8), (1, 8, 1, 1, "other", 1, 1), (2, 9, 1, 1, "other", 1, 1), (1, 9, 1, 4, " ", 0, 1)]
    got = matched(spark, [(1, 1, "a", "")], [(1, 9, sequence, 2, "Hash Join", "DISTRIBUTE")], steps)[1, 1]
    assert (got.actual_output_rows, got.actual_step_names, got.actual_movement) == (rows, names, "DISTRIBUTE")
    assert got.actual_max_data_skew == {1: 3.0, None: 8.0, 7: 0.0}[sequence] and got.actual_input_rows == 0.0 and got.plan_parent_id == 2


def test_no_joins_give_no_rows(spark):
    assert matched(spark, [], [(1, 1, 0, 0, "Hash Join", "")]) == {}
