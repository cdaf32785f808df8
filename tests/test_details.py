"""Rollups of captured details, steps located by name, first users, and places by classes."""

from pyspark.sql import functions as F

from querytide.operators import details, grouping, triage

FIELDS = "user_id int, query_id long, child_query_sequence int, metrics_level string, step_name string, step_id int, step_attribute string, stream_id int, segment_id int, plan_node_id int, plan_parent_id int, table_id long, table_name string, source string, is_rrscan boolean, start_time timestamp, end_time timestamp, duration long, input_bytes long, input_rows long, output_bytes long, output_rows long, blocks_read long, blocks_write long, local_read_io long, remote_read_io long, spilled_block_local_disk long, spilled_block_remote_disk long, data_skewness int, time_skewness int, alert string"
NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def frame(spark, *rows):
    return spark.createDataFrame([tuple(({"query_id": 1} | r).get(n) for n in NAMES) for r in rows], FIELDS)


def test_details_of_nothing_but_nulls(spark):
    (r,) = details.details_rollup(frame(spark, {}, {"alert": " "})).collect()
    assert (r.total_steps, r.alert_count, r.segments_used, r.external_steps) == (2, 0, 0, 0)
    assert (r.total_spill, r.input_rows, r.selectivity_ratio, r.remote_io_ratio, r.external_duration) == (None,) * 5
    (f,) = details.grouped_flow(frame(spark, {"plan_node_id": 1}, {"plan_node_id": 1})).collect()
    assert (f.detail_row_count, f.pain_score, f.dominant_pain, f.pain_points, f.detail_row_rank) == (2, 0.0, "NORMAL", "", 1)
    assert details.grouped_flow(frame(spark, {})).count() == 0, "neither a step, a plan node nor a level"
    assert details.grouped_flow(frame(spark)).count() == details.details_rollup(frame(spark)).count() == 0


def test_pains_add_up_and_ranks_are_inside_the_query(spark):
    bad = {"step_id": 2, "step_name": "Hash Join", "source": "S3", "alert": "x", "input_rows": 10_000_000, "spilled_block_remote_disk": 90_000, "data_skewness": 2, "remote_read_io": 5}
    got = {(r.query_id, r.step_id): r for r in details.grouped_flow(frame(spark, bad, {"step_id": 1, "data_skewness": 3}, bad | {"query_id": 2}), 1).collect()}
    r = got[1, 2]
    assert r.pain_score == 20 + 25 + 8 + 10 + 8 + 8 and r.dominant_pain == "ALERT" and r.pain_points == "ALERT;REMOTE_SPILL;REMOTE_IO;EXTERNAL_SOURCE;LARGE_JOIN;"
    assert (r.detail_row_rank, r.pain_rank, got[1, 1].pain_rank, got[2, 2].pain_rank) == (2, 1, 2, 1)
    many = details.grouped_flow(frame(spark, *[{"step_id": k} for k in range(40)]), 30)
    assert sorted(r.detail_row_rank for r in many.collect()) == list(range(1, 31))
    assert details.grouped_flow(frame(spark, *[{"step_id": k} for k in range(40)]), 3).count() == details.LEAST_ROWS


def test_steps_are_located_by_number_full_name_or_bare_name(spark):
    tables = spark.createDataFrame([(1, "s", "a"), (2, "t", "a"), (3, "t", "b"), (4, None, "c")], "table_id long, schema_name string, table_name string")
    steps = spark.createDataFrame([(0, 3, "s", "a"), (1, None, "T", "A"), (2, None, "x", "a"), (3, 99, "t", "b"), (4, 99, "x", "none"), (5, None, None, None), (6, None, None, "c"), (7, None, "", "B")], "n int, table_id long, schema_name string, table_name string")
    assert {r.n: r.table_id for r in triage.located(steps, tables).collect()} == {0: 3, 1: 2, 2: 1, 3: 3, 4: 99, 5: None, 6: 4, 7: 3}


def test_first_users_and_places(spark):
    rows = spark.createDataFrame([("g", "Bo", 3), ("g", "bo", 1), ("g", " Al ", 2), ("g", "", 0), ("h", None, 1), (None, "Cy", 1)], "k string, u string, o int")
    assert {r.k: r.users for r in grouping.first_users(rows, ["k"], "u", "o").collect()} == {"g": "bo, Al", "h": "", None: "Cy"}
    assert {r.k: r.users for r in grouping.first_users(rows, ["k"], "u", "o", 1).collect()}["g"] == "bo"
    scores = spark.createDataFrame([(i, float(i % 7) if i % 5 else None) for i in range(50)], "id int, s double")
    got = {r.id: r.p for r in grouping.placed(scores, "s", [F.desc_nulls_last("s"), F.asc("id")], "p").collect()}
    want = sorted(range(50), key=lambda i: (i % 5 == 0, -(i % 7) if i % 5 else 0, i))
    assert got == {i: k for k, i in enumerate(want, 1)}
