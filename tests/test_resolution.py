"""Names resolved by database, external tables assembled from stages, ranks within snapshots."""

import random
import re

import pytest
from pyspark.sql import functions as F

from querytide.operators import assembly, gold, triage

CATALOG = [("db1", "s", "orders", ""), ("db2", "s", "orders", ""), ("db1", "s", "only", ""), ("DB1", '"t"', "one_name", "db1.t.one_name"), ("db1", "", "flat", ""), (None, "x", "nodb", None), ("db1", "a", "twice", ""), ("db1", "b", "twice", "")]


@pytest.mark.parametrize(
    ("mention", "database", "key", "way"),
    [
        ("db2.s.orders", "db1", "db2.s.orders", triage.FULL), ('"DB1"."S"."Orders"', None, "db1.s.orders", triage.FULL), ("s.orders", "DB2 ", "db2.s.orders", triage.IN_DATABASE),
        ("db9.s.orders", "db1", "db1.s.orders", triage.IN_DATABASE), ("s.orders", "", None, None), ("s.orders", "db3", None, None), ("orders", "db1", None, None), ("only", "db7", "db1.s.only", triage.ONE_NAME),
        ("s.only", "db7", "db1.s.only", triage.ONE_SCHEMA), ("zz.only", "", "db1.s.only", triage.ONE_NAME), ("twice", "db1", None, None), ("b.twice", "", "db1.b.twice", triage.ONE_SCHEMA), ("flat", "db1", "db1.flat", triage.IN_DATABASE),
        ("nodb", "db1", "x.nodb", triage.ONE_NAME), ("one_name", None, "db1.t.one_name", triage.ONE_NAME), ("", "db1", None, None), (None, "db1", None, None),
    ],
)
def test_names_by_database(spark, mention, database, key, way):
    cat = spark.createDataFrame(CATALOG, "source_db string, schema_name string, table_name string, table_key string")
    got = triage.resolved_by_database(spark.createDataFrame([(mention, database, 1)], "mention string, database_name string, n int"), cat).collect()
    assert [(r.mention, r.database_name, r.n, r.table_key, r.found_by) for r in got] == [(mention, database, 1, key, way)]


def stages(spark):
    tables = spark.createDataFrame([("D", "s", "t", "s3://b/t/", "TABLE"), ("d", "s", "u", "s3://b/t/u", None), ("e", "s", "t", "s3://b/t/", ""), ("d", "s", "v", "s3://b", "VIEW")], "`REDSHIFT_DATABASE_NAME ` string, schemaname string, tablename string, location string, tabletype string")
    columns = spark.createDataFrame([("d.s.t", "y", "2"), ("d.s.t", "x", "1"), ("d.s.t", "z", "none"), ("d.s.t", "w", "2")], "external_table_key string, columnname string, part_key string")
    history = spark.createDataFrame([(1, "d "), (2, "E"), (3, "f")], "query_id long, database_name string")
    details = spark.createDataFrame(
        [(1, 0, "s3", "T", "s3://b/t/u/f", 10, 3, "bad format"), (1, 1, "S3", "", "S3://b/t/u/f", 20, None, None), (1, 2, "s3", None, "s3://b/t/f", 40, None, "x"), (2, 0, "s3", "s.t", "", 80, None, ""), (3, 0, "s3", "t", "s3://b/t/f", 160, None, ""), (1, 3, "local", "t", "", 320, None, "")],
        "query_id long, segment_id long, source_type string, table_name string, file_location string, returned_rows long, total_partitions int, warning_message string",
    )
    steps = spark.createDataFrame([(1, 0, "s.t", 5, 50, 0, "scan", "s3"), (1, 0, "t", 2, 20, 1, "Scan", "S3"), (1, 0, "t", 9, 9, -1, "scan", "s3"), (1, 1, "u", 7, 7, 0, "scan", "s3")], "query_id long, segment_id long, table_name string, output_rows long, output_bytes long, step_id int, step_name string, source string")
    errors = spark.createDataFrame([(1, "s3://b/t/u/q", "1", "c", "Truncated", None, 5), (1, "s3://b/t/u/q", "1", "c", "Truncated", None, 5), (1, "s3://b/t/q", "1", "d", None, None, 6), (2, "elsewhere", "1", "d", None, None, 6)], "query_id long, file_location string, rowid string, column_name string, trigger string, action string, error_code long")
    return {"svv_external_tables": tables, "external_column_stats": columns, "sys_query_history": history, "sys_external_query_detail": details, "sys_query_detail": steps, "sys_external_query_error": errors}


def test_assembly_matches_in_the_querys_database_and_orders_partition_keys(spark):
    got = {r.external_table_key: r for r in assembly.assembled(spark, stages(spark)).collect()}
    assert set(got) == {"d.s.t", "d.s.u", "e.s.t"}, "views stay out"
    t, u, e = (got[k] for k in ("d.s.t", "d.s.u", "e.s.t"))
    assert t.partition_key_columns == "x, w, y" and (t.column_count, t.partition_key_count) == (4, 3), "a part_key that is no number is null"
    assert (t.gross_scan_rows, u.gross_scan_rows, e.gross_scan_rows) == (50, 20, 80), "names before locations, the longest location, blank names by place"
    assert t.gross_output_rows == 2 and t.output_metric_match_count == 1, "the step of the same name goes before one that ends in it"
    assert u.gross_output_rows is None and u.filtering_assessment == "OUTPUT_UNAVAILABLE"
    assert (t.schema_format_warning_count, t.other_warning_count, t.warning_event_count) == (1, 1, 2)
    assert (u.sampled_error_count, u.truncation_error_count, t.sampled_error_count, t.other_error_count, e.sampled_error_count) == (1, 1, 1, 1, 0)


@pytest.mark.parametrize("missing", [*assembly.STAGES, None])
def test_assembly_without_a_stage(spark, missing):
    full = assembly.assembled(spark, stages(spark))
    frames = {} if missing is None else {k: v for k, v in stages(spark).items() if k != missing}
    part = assembly.assembled(spark, frames)
    assert part.dtypes == full.dtypes
    rows = part.collect()
    assert len(rows) == (0 if missing in ("svv_external_tables", None) else 3)
    if missing == "external_column_stats":
        assert {(r.column_count, r.partition_key_columns) for r in rows} == {(0, "")}
    if missing in ("sys_query_history", "sys_external_query_detail"):
        assert {(r.query_count, r.filtering_assessment, r.partition_pruning_pct) for r in rows} == {(0, "NO_ACTIVITY", None)}
    if missing == "sys_query_detail":
        assert {r.gross_output_rows for r in rows} == {None} and max(r.query_count for r in rows) == 1


def test_assembly_shuffles_segments_by_query_only(spark):
    plan = assembly.assembled(spark, stages(spark))._jdf.queryExecution().executedPlan().toString()
    wide = re.findall(r"hashpartitioning\(query_id#\d+L, segment_id#", plan)
    assert not wide and "Exchange hashpartitioning(query_id#" in plan


def test_assembly_is_the_same_with_large_catalogues(spark, monkeypatch):
    few = sorted(map(str, assembly.assembled(spark, stages(spark)).collect()))
    monkeypatch.setattr(assembly, "MOST_BROADCAST", 0)
    assert sorted(map(str, assembly.assembled(spark, stages(spark)).collect())) == few


def test_a_snapshots_rank_keeps_its_best_rows_before_the_exchange(spark):
    r = random.Random(1)
    rows = [(r.choice("ab") if i % 9 else None, f"s{i % 50}", f"r{i}", r.choice([None, 1.0, 2.0, 3.0])) for i in range(600)]
    df = spark.createDataFrame(rows, "snap string, subject string, rule_id string, score double").repartition(5)
    found = gold.ranked_by(df, "snap", "score", 7)
    want = []
    for s in ("a", "b", None):
        own = sorted((x for x in rows if x[0] == s), key=lambda x: (x[3] is None, -(x[3] or 0), x[1], x[2]))[:7]
        want += [(*x, k) for k, x in enumerate(own, 1)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and ", Partial" in plan.replace("\n", ""), plan
    assert dict(found.dtypes)["priority_rank"] == "bigint" and found.where(F.col("priority_rank") > 7).isEmpty()
