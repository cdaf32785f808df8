"""Telemetry operators: registered queries against their SQL, rule counts, storage and imports."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from querytide.functions import exprs, shapes
from querytide.operators import external, grouping, rollups, triage
from querytide.plans import core, registry
from querytide.sources import capture, pastes, storage
from querytide.sources.adapter import relation
from querytide.streaming import ingest

TABLES = "documents labels benchmark pages conversations embeddings region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)]
    cell = lambda v: "null" if pd.isna(v) else repr(float(v)) if hasattr(v, "__float__") and not isinstance(v, (str, bool)) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_matches_its_sql(spark, sf, duck, name):
    got, expect = registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expect.columns)
    assert plain(got) == plain(expect)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLES])
def test_other_queries_run(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rule_counts_of_the_specification(spark):
    """Hits of the rules on the adapter's projection at scale 0.01, as specified beside the projections."""
    expect = {"Q01_REMOTE_SPILL": 7428, "Q02_EXTERNAL_SPILL": 4206, "Q03_REMOTE_IO_RATIO": 12812, "Q04_DATA_SKEW_STEP": 13343, "Q05_TIME_SKEW_STEP": 13701, "Q06_BROADCAST_JOIN": 5031, "Q07_DS_DIST_BOTH": 4949, "Q08_DIST_HEAVY": 697, "Q09_NESTED_LOOP": 4885, "Q10_MISSING_STATS_PLAN": 7507, "Q12_EXTERNAL_SHARE": 3850, "Q13_EXTERNAL_LOW_SELECTIVITY": 532, "Q14_SEQ_SCAN_HEAVY": 363, "Q15_PARTITION_LOOP": 4954, "Q16_NETWORK_NODE": 4884, "Q17_HIGH_COST_SCORE": 228, "Q18_ALERT_COUNT": 3926, "Q19_ROW_EXPANSION": 1777, "Q20_INPUT_WASTE": 77, "Q21_SELECT_STAR": 1875, "Q22_LEADING_WILDCARD": 1875, "Q23_UNION_DISTINCT": 1875, "Q24_CROSS_JOIN": 1875, "Q25_ORDER_BY_NO_LIMIT": 1875, "T26_TABLE_SKEW": 1142, "T27_UNSORTED": 1649, "T28_STATS_OFF": 1248, "T29_VACUUM_BENEFIT": 1200, "T30_LARGE_ALL_TABLE": 246, "T31_LARGE_EVEN_TABLE": 395, "T32_NO_SORTKEY_LARGE": 994}
    found = {r.rule_id: r.findings for r in core.insight_families(spark, "/root/testdata/sf0.01").collect()}
    assert {k: found.get(k, 0) for k in expect} == expect


def test_plans_read_only_needed_columns(spark, sf):
    plan = relation(spark, sf, "steps").groupBy("query_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" in plan and "l_comment" not in plan and "l_tax" not in plan


# Grouping --------------------------------------------------------------------------------------
def grouped(spark, *texts, **columns):
    rows = [(i, t, columns.get("query_type", "SELECT"), "db", columns.get("user", f"u{i}"), float(i + 1), 1.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "query_id long, sql_text string, query_type string, database_name string, user_name string, elapsed_s double, risk_score double")
    return grouping.candidates(df, columns.get("by_user", False))


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("select a from sales.orders where d = '2024-01-01'", "select a from sales.orders where d = '2024-02-09'", True),
        ("select a from sales.orders where k in (1,2,3)", "select a from sales.orders where k in (7)", True),
        ("select a from sales.orders where k = 1 -- x", "/* c */ SELECT  a\nFROM sales.orders WHERE k = 2", True),
        ("UNLOAD ('select a from sales.orders where d = ''x''') TO 's3://b/1'", "unload ('select a from sales.orders where d = ''y''') to 's3://b/2'", True),
        ("select a from sales.orders limit 10", "select a from sales.orders limit 999", True),
        ("select a from sales.orders where k = 1", "select a from sales.refunds where k = 1", False),
        ("call etl.load_day('2024-01-01')", "CALL etl.load_day('2025-01-01')", True),
        ("call etl.load_day(1)", "call etl.load_week(1)", False),
        ("insert into t_big values (1, 'a'), (2, 'b')", "insert into t_big values (3, 'c')", True),
        ("select a from stg_load_10001 where x = 1", "select a from stg_load_20002 where x = 1", True),
        ('select a from "Sales"."A" where k = 1', 'select a from "Sales"."B" where k = 1', False),
    ],
)
def test_statements_group(spark, a, b, same):
    keys = {r.constraint_key for r in grouped(spark, a, b).collect()}
    assert len(keys) == (1 if same else 2)


def test_short_statements_and_users(spark):
    assert grouped(spark, "select 1", "select 1").count() == 0
    text = "select a from sales.orders where k = 1"
    assert len({r.constraint_key for r in grouped(spark, text, text, by_user=True).collect()}) == 2


def test_fuzzy_merge_is_complete_link(spark):
    base = "select a1, a2, a3, a4, a5, a6, a7, a8, a9, b1, b2, b3, b4 from sales.orders where k = ? and region = "
    far = "select count(*) from sales.orders group by totally, different, things, altogether"
    found = {r.constraint_key: r for r in grouping.fuzzy_merged(grouped(spark, base + "x", base + "y", far)).collect()}
    merged = [r.merged_key for r in found.values()]
    assert len(found) == 3 and len(set(merged)) == 2 and min(r.similarity for r in found.values()) >= grouping.FUZZY
    assert abs(grouping.indel_ratio("abcd", "abxd") - 0.75) < 1e-9 and grouping.indel_ratio("", "") == 1.0


def test_similar_statements_are_not_dropped_before_scoring(spark):
    names = [f"{chr(97 + i)}_{'long_column_name_' * 3}" for i in range(8)]
    text = lambda end: f"select {', '.join(n + end for n in names)} from t"
    q = spark.createDataFrame([(1, text("x")), (2, text("y")), (3, "vacuum u")], "query_id long, sql_text string")
    pairs = q.crossJoin(q.limit(1).selectExpr("sql_text as left_text")).withColumns({"left_shape": shapes.regex_shape("left_text"), "right_shape": shapes.regex_shape("sql_text")})
    least = grouping.pair_similarity(pairs).where("query_id = 2").first().similarity - 0.01
    assert [r.query_id for r in grouping.similar_to(text("x"), q, least).collect()] == [1, 2]


def test_call_keys(spark):
    rows = spark.createDataFrame([("call a.b.c(1)",), ("CALL s.p()",), ("call p (2)",), ("select 1",)], "t string")
    assert [r[0] for r in rows.select(shapes.call_key("t", shapes.F.lit("DB"))).collect()] == ["a.b.c", "db.s.p", "db..p", None]


def test_all_calls_are_resolved(spark, sf):
    calls = relation(spark, sf, "statements").where("sql_text like 'CALL %'")
    got = registry.QUERIES["call_resolution"](spark, sf)
    assert 0 < got.count() == calls.count() == got.join(calls, "query_id").where("call_key = concat('db1.', regexp_extract(sql_text, 'CALL (.*)[(]', 1))").count()
    texts = spark.createDataFrame([("/* x */ call load_1(7)",), ("CALL etl.load_1 (7)",), ("call nowhere()",), ("select 1",)], "sql_text string").select(shapes.call_key("sql_text", shapes.F.lit("DB1")).alias("call_key"))
    procs = spark.createDataFrame([("DB1.etl.load_1",), ("db1.etl.load_2",)], "procedure_key string")
    assert sorted(r.call_key for r in grouping.resolved_calls(texts.where("call_key is not null"), procs).collect()) == ["db1..nowhere", "db1.etl.load_1", "db1.etl.load_1"]


def test_whole_tables_reach_the_operators(spark, sf):
    got, n = (lambda name: registry.QUERIES[name](spark, sf)), (lambda name: spark.read.parquet(f"{sf}/{name}.parquet").count())
    assert got("procedure_statements").count() == 2 * n("orders") and got("catalog_cache").count() == n("part")
    errors = relation(spark, sf, "segments").selectExpr("query_id * 10 + segment_id").distinct()
    assert got("external_errors").agg({"error_count": "sum"}).first()[0] == errors.count()


def test_incremental_features_parse_each_statement_once(spark):
    q = spark.createDataFrame([(1, "select a from t where x = 1"), (2, "select a from t where x = 1"), (3, "select b from u")], "query_id long, sql_text string")
    first = grouping.features(q.limit(0).select(shapes.F.lit("").alias("sql_hash"), "sql_text")).drop("sql_text")
    rows, fresh = grouping.incremental_features(q, first)
    assert fresh.count() == 2 and rows.count() == 3
    again, new = grouping.incremental_features(q, fresh)
    assert new.count() == 0 and again.count() == 3


# Storage ---------------------------------------------------------------------------------------
def test_store_replaces_appends_promotes_and_backs_up(spark, tmp_path):
    store = storage.Store(spark, f"file://{tmp_path}/store")
    rows = lambda *r: spark.createDataFrame(list(r), "query_id string, v string, namespace_id string")
    store.replace("t", storage.stamped(rows(("1", "a", "n1"), ("2", "b", "n2")), "s1"))
    store.replace("t", storage.stamped(rows(("1", "c", "n1")), "s1"))
    read = lambda: sorted((r.query_id, r.v, r.namespace_id) for r in store.read("t").collect())
    assert read() == [("1", "c", "n1"), ("2", "b", "n2")], "other namespaces stay"
    assert not store.replace("t", storage.stamped(rows(), "s1")) and len(read()) == 2, "an empty frame replaces nothing"
    store.append("t", storage.stamped(rows(("1", "d", "n1"), ("3", "e", "n1")), "s1"), ["query_id"])
    assert read() == [("1", "d", "n1"), ("2", "b", "n2"), ("3", "e", "n1")]
    store.stage("t", storage.stamped(rows(("9", "z", "n2")), "other"))
    assert store.promote("s1", ["t"]) == ["t"] and len(read()) == 3, "a foreign snapshot is refused"
    store.stage("t", storage.stamped(rows(("9", "z", "n2")), "s1"))
    assert store.promote("s1", ["t"]) == [] and ("9", "z", "n2") in read()
    assert store.backup(f"file://{tmp_path}/copy", ["t"]) == {"t": 3}
    store.truncate("t")
    assert read() == []


def test_namespace_stamp_and_text_values(spark):
    df = spark.createDataFrame([(1.5, b"x", " "), (float("nan"), None, "n")], "a double, b binary, namespace_id string")
    assert [r.namespace_id for r in storage.stamped(df, "s").collect()] == ["producer", " n".strip()]
    assert [(r.a, r.b) for r in storage.stringified(df).collect()] == [("1.5", "x"), (None, None)]
    assert storage.conformed(df, ["z", "a"]).columns == ["z", "a", "b", "namespace_id"]


def test_first_source_wins(spark):
    s = lambda ns, v: spark.createDataFrame([(n, v) for n in ns], "namespace_id string, v int")
    got = sorted((r.namespace_id, r.v, r.snapshot_id) for r in storage.merged([s(["a", "b"], 1), s(["b", "c"], 2)], "m").collect())
    assert got == [("a", 1, "m"), ("b", 1, "m"), ("c", 2, "m")]


# Imports ---------------------------------------------------------------------------------------
def test_pastes(spark):
    text = "┌────┐\n| step_name | table_id | segmentid | stream id | step_id | is_rrscan | duration |\n|---|---|---|---|---|---|---|\n| scan | 7 | 1 | 0 | 2 | t | 12 |\n| hash join | NULL | 0 | 0 | 1 | f | oops |\n"
    got = capture.pasted_steps(spark, text).collect()
    assert [(r.step_name, r.table_id, r.step_id, r.is_rrscan, r.elapsed_time) for r in got] == [("hash join", None, 1, False, None), ("scan", 7, 2, True, 12)]
    t = capture.pasted_tables(spark, "table\tsize_mb\tunsorted_pct\tcreated\nt1\t10\t5\t2024-05-01 10:00:00\nt2\t<null>\t7.5\tsoon").collect()
    assert [(r.table, r.size, r.unsorted, str(r.create_time)) for r in t] == [("t1", 10, 5.0, "2024-05-01 10:00:00"), ("t2", None, 7.5, "None")]
    with pytest.raises(ValueError, match="no column"):
        capture.pasted_steps(spark, "5,6\n1,2\n3,4")
    names = list(capture.STEP_COLUMNS)
    assert len(names) == 38 and len(capture.TABLE_COLUMNS) == 22
    positional = "\n".join(",".join("scan" if c == "step_name" else "x" if t == "string" else str(i) for c, t in capture.STEP_COLUMNS.items()) for i in range(3))
    assert [(r.query_id, r.step_name, r.alert_type) for r in capture.pasted_steps(spark, positional).collect()] == [(i, "scan", "x") for i in range(3)]


def said(df):
    return [r[1] for r in df.orderBy("no").collect()]


def test_one_bad_line_does_not_cost_the_good_ones(spark):
    rows = pastes.cells(pastes.content(pastes.lines_of(spark, "a\tb\n1\t2\n3\t4\n5\t6\tjunk\n7\n")), "\t", 2)
    assert said(rows) == [["a", "b"], ["1", "2"], ["3", "4"], ["7", None]]
    quoted = pastes.cells(pastes.lines_of(spark, 'x, "a, ""b""", NaN\ny,,\n'), ",", 3)
    assert said(quoted)[:2] == [["x", 'a, "b"', None], ["y", None, None]]


def test_pastes_lose_row_numbers_and_drawn_lines(spark):
    assert said(pastes.content(pastes.lines_of(spark, "├───┼───┤\r\n| a | b |\r1 | foo | bar\n2: x | y\n----\n12 apples  "))) == [" a | b ", "foo | bar", "x | y", "12 apples"]


@pytest.mark.parametrize(("text", "sep"), [("a;b,c,d\n1;2,3,4", ","), ("a|b;c\n1|2\n3|4", "|"), ("a  b   c\n1  2  3", pastes.BLANKS), ("", pastes.BLANKS), ("a\tb|c\n1\t2|3", "\t")])
def test_delimiters_are_scored(spark, text, sep):
    assert pastes.separator(pastes.lines_of(spark, text)) == sep


def test_headers_and_shapes(spark):
    known = set(capture.STEP_COLUMNS) | set(capture.STEP_ALIASES)
    assert pastes.is_header(["Step Name", "zzz"], known) and pastes.is_header(["xid", "a", "b", "c"], known)
    assert not pastes.is_header(["xid", "1", "2024-01-01", None], known) and not pastes.is_header(["a", "b"], known) and not pastes.is_header([], known)
    columns = [["2024-01-01 10:00", "2024-01-02 10:00"], ["hash join", "scan"], ["1", "2"] * 40, [str(i * 7) for i in range(80)], ["t_a", "t_b"], ["1,5", "x", "3"], []]
    rows = [(i, [c[i] if i < len(c) else None for c in columns]) for i in range(80)]
    df = spark.createDataFrame(rows, "no long, cells array<string>").repartition(3)
    assert pastes.named_by_values(df, 7, capture.STEP_COLUMNS) == ["start_time", "step_name", "step_id", "elapsed_time", "table_name", "col_5", "schema_name"]
    assert pastes.named_by_values(df, 38, capture.STEP_COLUMNS) == list(capture.STEP_COLUMNS)


def test_a_file_is_probed_by_its_first_bytes_and_split_at_blanks(spark, tmp_path):
    (tmp_path / "f.txt").write_text("name   size\nfirst one  5\nx  None\ntoo  many  here\n")
    assert [tuple(r) for r in capture.imported(spark, str(tmp_path / "f.txt")).collect()] == [("first one", "5"), ("x", None)]
    (tmp_path / "big.csv").write_text("a;b\n" + "é;1\n" * 40_000)
    store = storage.Files(spark)
    assert len(store.head(str(tmp_path / "big.csv"), pastes.PROBE)) == pastes.PROBE
    assert pastes.probed(("x" + "é" * pastes.PROBE).encode()[: pastes.PROBE])[0] == "UTF-8"
    assert capture.imported(spark, str(tmp_path / "big.csv")).where("a = 'é'").count() == 40_000


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-16", "cp1252"])
def test_file_imports(spark, tmp_path, encoding):
    p = tmp_path / "f.csv"
    p.write_bytes("Name;Größe “€”\nä – “x”;1\nNULL;2\n".encode(encoding))
    rows = capture.imported(spark, str(p)).collect()
    assert [(r[0], r[1]) for r in rows] == [("ä – “x”", "1"), (None, "2")]
    assert capture.imported(spark, str(p)).columns == ["name", "größe “€”"]


def test_definitions_and_globs(spark):
    df = spark.createDataFrame([("v", "select 1 ", None, "from t  ")], "name string, definition_part_01 string, definition_part_02 string, definition_part_03 string")
    assert capture.definitions(df).first().source_definition == "select 1 from t"
    names = spark.createDataFrame([("fact_a",), ("factXa",), ("fact_%",)], "table_name string")
    assert sorted(r[0] for r in names.where(exprs.glob_like("table_name", "fact_*")).collect()) == ["fact_%", "fact_a"]


def test_failures_do_not_stop_a_load(spark):
    done, failed = capture.collected({"a": lambda: spark.range(1), "b": lambda: 1 / 0})
    assert list(done) == ["a"] and failed[0][0] == "b" and "ZeroDivisionError" in failed[0][1]


# Advice and external tables --------------------------------------------------------------------
def test_script_runs_maintenance_and_comments_design(spark, sf):
    from querytide.plans import designs

    lines = designs.fix_script(spark, sf)
    assert all(r.line.startswith("--") == (r.section == "design") for r in lines.collect())
    advice = triage.fix_script(designs.reviewed(spark, sf), triage.sortkey_advice(designs.stats(spark, sf), designs.reviewed(spark, sf)))
    assert "-- maintenance" in triage.script_text(advice)


def test_longest_prefix_wins(spark):
    catalog = spark.createDataFrame([(1, "x", "a", "s3://b/x/"), (2, "x", "c", "s3://b/x/y/")], "ext_id long, schema_name string, table_name string, location string")
    seg = spark.createDataFrame([(1, 1, "", "s3://b/x/y/z/f"), (1, 2, "a", "s3://b/x/y/f"), (1, 3, "", "s3://b/xx/f")], "query_id long, segment_id long, table_name string, file_location string")
    assert {r.segment_id: r.ext_id for r in external.matched(seg, catalog).collect()} == {1: 2, 2: 1, 3: None}


def test_text_assembly_orders_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, None, "c"), (1, 3, None)], "query_id long, sequence int, text string")
    assert rollups.assembled(df, "query_id").first().sql_text == "abc"


# Stream ----------------------------------------------------------------------------------------
def test_stream_appends_each_query_once(spark, tmp_path):
    src, store = str(tmp_path / "in"), storage.Store(spark, f"file://{tmp_path}/store")
    rows = [("q1", "n1", "2024-01-01 00:00:00", 5), ("q2", "n1", "2024-01-01 00:10:00", 6), ("q1", "n1", "2024-01-01 00:00:00", 5)]
    df = spark.createDataFrame(rows, "query_id string, namespace_id string, start_time string, elapsed_time long")
    df.withColumn("start_time", df.start_time.cast("timestamp_ntz")).write.parquet(src)
    schema = spark.read.parquet(src).schema
    ingest.into_store(ingest.history_stream(spark, src, schema), store, "h", ["query_id"], "s1", str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.query_id for r in store.read("h").collect()) == ["q1", "q2"]
    out = ingest.arrivals(ingest.history_stream(spark, src, schema)).writeStream.format("memory").queryName("arr").outputMode("complete").trigger(availableNow=True).start()
    out.awaitTermination()
    assert [(r.queries, r.elapsed_time) for r in spark.sql("select * from arr").collect()] == [(2, 11)]


# Reports and recovery --------------------------------------------------------------------------
def test_report_merges_near_equal_shapes_before_sizes_are_judged(spark):
    from querytide.operators import grouping

    base = "select a, b, c from sales.orders_fact where customer_region = 'x' and order_total_amount > 5 order by order_total_amount desc"
    texts = [base, base.replace("5", "7"), base.replace("order by order_total_amount desc", "order by order_total_amount asc"), "select z from other.table_two where q = 1 and r = 2", base]
    rows = [(i, t, "u", "db", "SELECT", float(i), float(i), 10 * i) for i, t in enumerate(texts)]
    q = spark.createDataFrame(rows, "query_id long, sql_text string, user_name string, database_name string, query_type string, elapsed_s double, risk_score double, spill long")
    found = grouping.candidates(q)
    plain = grouping.report(found, ["spill"], ["elapsed_s"]).collect()
    assert [(r.query_count, r.query_ids) for r in plain] == [(3, [0, 1, 4])]
    (g,) = grouping.report(found, ["spill"], ["elapsed_s"], grouping.fuzzy_merged(found)).collect()
    assert (g.query_count, g.query_ids, g.representative_id, g.total_spill, g.avg_elapsed_s, g.shape_count) == (4, [0, 1, 2, 4], 0, 70, 1.75, 2)
    assert g.all_tables == g.common_tables == "sales.orders_fact" and g.min_similarity < 1.0 and g.repeat_group_key.startswith("G")


def test_fuzzy_groups_match_brute_force(spark):
    import random

    from querytide.operators import grouping

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdef") for _ in range(6))
    texts = []
    for _ in range(6):
        stem = f"select {', '.join(word() for _ in range(12))} from s.t_one where {word()} = 1 and "
        texts += [stem + word() + " = 2" for _ in range(4)]
    q = spark.createDataFrame([(i, t, "u", "db", "SELECT", 1.0, 1.0) for i, t in enumerate(texts)], "query_id long, sql_text string, user_name string, database_name string, query_type string, elapsed_s double, risk_score double")
    found = grouping.candidates(q)
    got = {x.constraint_key: x.merged_key for x in grouping.fuzzy_merged(found).collect()}
    shapes = sorted({(x.shape, x.constraint_key) for x in found.select("shape", "constraint_key").collect()}, key=lambda x: (len(x[0]), x[0]))

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            row = _lcs_row(row, c, b)
        return 2 * row[-1] / (len(a) + len(b))

    def _lcs_row(before, c, b):
        out = [0]
        for j, d in enumerate(b, 1):
            out.append(before[j - 1] + 1 if c == d else max(before[j], out[-1]))
        return out

    clusters: list[list] = []
    for s, k in shapes:
        home = next((c for c in clusters if len(s) <= len(c[0][0]) * 1.25 and min(ratio(s, x) for x, _ in c) >= 0.95), None)
        clusters.append([(s, k)]) if home is None else home.append((s, k))
    assert got == {k: c[0][1] for c in clusters for _, k in c} and len(clusters) < len(shapes)


def test_clusters_close_with_their_length_band_and_runs_split_blocks(spark):
    from querytide.operators import grouping

    import pandas as pd

    shape = lambda n, c="a": c * n
    clusters, out, most = grouping._Clusters(), [], 0
    for n in range(20, 400):
        out += clusters.add(shape(n), f"k{n}")
        most = max(most, sum(len(c["shapes"]) for c in clusters.open))
    out += clusters.close()
    assert sorted(k for k, _, _ in out) == sorted(f"k{n}" for n in range(20, 400))
    assert most < 90, "what is more than a tenth shorter is let go"
    batches = [pd.DataFrame({"run": ["a", "b"], "shape": [shape(50), shape(50)], "constraint_key": ["1", "2"]}), pd.DataFrame({"run": ["b"], "shape": [shape(51)], "constraint_key": ["3"]})]
    got = pd.concat(grouping._clustered(iter(batches)))
    assert dict(zip(got["constraint_key"], got["merged_key"], strict=True)) == {"1": "1", "2": "2", "3": "2"}
    rows = spark.createDataFrame([("r", n) for n in (100, 105, 110, 150, 155)], "run string, width int")
    runs = grouping._split_runs(rows, "width").groupBy("run").agg({"width": "count"}).collect()
    assert sorted(r[1] for r in runs) == [2, 3]


def test_store_recovers_restores_and_empties(spark, tmp_path):
    store = storage.Store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("1", "n1"), ("2", "n2")], "query_id string, namespace_id string")
    store.stage("lost", storage.stamped(rows, "s1"))
    store.stage("mixed", storage.stamped(rows, "s1").unionByName(storage.stamped(rows, "s2")))
    assert store.recover(["lost", "mixed", "never"]) == ["lost"] and store.read("lost").count() == 2
    store.replace("roster", storage.stamped(rows, "s1"))
    store.backup(f"file://{tmp_path}/copy", ["lost"])
    assert store.truncate_all(["lost", "roster", "never"]) == ["lost"] and store.read("lost").count() == 0 and store.read("roster").count() == 2
    assert store.restore(f"file://{tmp_path}/copy", ["lost"]) == {"lost": 2}
    made = []
    key = storage.analysis_key({"b": 1, "a": 2}, rows)
    assert key == storage.analysis_key({"a": 2, "b": 1}, rows.orderBy("query_id", ascending=False)) != storage.analysis_key({"a": 2}, rows)
    for _ in range(2):
        assert store.cached(key, lambda: made.append(1) or rows).count() == 2
    assert made == [1]


def test_markdown_and_scripts_hold_every_row(spark):
    text = storage.markdown(spark.range(6000).selectExpr("id", "concat('a|', id) as t"), "Rows")
    assert text.count("\n") == 6004 and "| 5999 | a\\|5999 |" in text


def test_external_assessment_of_pushdown_and_spill(spark):
    t = spark.createDataFrame(
        [(1, "parquet", "numRows=1", 30, 120.0, 0, 1, 3, 95.0, 0, 0, 0), (2, "text", "", 6, 120.0, 10, 0, 3, 60.0, 5, 0, 2), (3, "orc", "numrows=5", 1, 1.0, 0, 1, 0, None, 0, 6, 0)],
        "ext_id int, input_format string, parameters string, query_count int, scan_gb double, total_partitions int, partition_keys int, output_metric_match_count int, row_filter_efficiency_pct double, external_spill_blocks int, warning_count int, error_count int",
    ).selectExpr("*", "case when total_partitions > 0 then 20.0 end as partition_pruning_pct", "1 as s3list_time_ms", "1.0 as avg_files_per_segment", "1.0 as files_per_query", "1.0 as external_duration_s")
    got = {r.ext_id: ([(i["code"], i["weight"]) for i in r.issues], r.score, r.priority, r.confidence) for r in external.assessed(t).collect()}
    assert got[1] == ([("MATERIALIZE_OR_STAGE", 25), ("PUSHDOWN", 20)], 45, "high", "high")
    assert got[2][0] == [("COLUMNAR_FORMAT", 30), ("PARTITION_DESIGN", 30), ("DATA_QUALITY", 20), ("LOCAL_STAGE_DESIGN", 12), ("PUSHDOWN", 12), ("EXTERNAL_STATISTICS", 12)] and got[2][1:3] == (100, "critical")
    assert got[3] == ([("DATA_QUALITY", 12)], 12, "low", "medium")
