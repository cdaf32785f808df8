"""Faults that show only on tables larger than the fixtures', or on names that they lack."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from querytide.functions import exprs
from querytide.operators import assembly, details, enrichment, external, gold, grouping, lookups, triage
from querytide.plans import core, flows, layers
from querytide.plans.statement import batch, facts, rewrites, sharing, stages, tree
from querytide.sources import storage


def _views(spark, *rows):
    return spark.createDataFrame(list(rows), "view_key string, source_definition string")


def test_closure_follows_names_with_long_numeric_suffixes(spark):
    tables = spark.createDataFrame([("lake.ext_1234",), ("lake.ext_5",)], "table_key string")
    v = _views(spark, ("db.s.view_998", "select a from s.view_999 where a > 1"), ("db.s.view_999", "select a from lake.ext_1234"))
    t, seen = lookups.catalog_closure(["view_998"], tables, v)
    assert [r["table_key"] for r in t.collect()] == ["lake.ext_1234"]
    assert sorted(r["view_key"] for r in seen.collect()) == ["db.s.view_998", "db.s.view_999"]


def test_views_name_external_tables_with_long_numeric_suffixes(spark):
    external = spark.createDataFrame([("lake.ext_1234",), ("lake.ext_5",)], "external_table_key string")
    v = _views(spark, ("db.s.a", "select a from lake.ext_1234 join t on t.a = 1"), ("db.s.b", "select a from ext_5"))
    found = {r["view_key"]: r["external_tables"] for r in lookups.external_views(v, external).collect()}
    assert found == {"db.s.a": ["lake.ext_1234"], "db.s.b": ["lake.ext_5"]}


def _parses(monkeypatch):
    seen = []
    monkeypatch.setattr(tree, "Reader", lambda sql, real=tree.Reader: (seen.append(sql), real(sql))[1])
    return seen


SAME_FORM = [f"select a, '{k}x' from s.f where v > {k + 10000} and n like '%{k}' and d = {k + 10000}" for k in range(50)]


def test_facts_read_statements_of_one_form_once(monkeypatch):
    seen = _parses(monkeypatch)
    batch = pd.DataFrame({"sql_hash": SAME_FORM, "sql_text": SAME_FORM, "shape": "", "sql_tables": "", "join_count": 0, "predicate_count": 0, "subquery_count": 0, "wildcard_count": 0})
    got = pd.concat(facts._analyse(iter([batch])))
    assert len(seen) == 1
    text = SAME_FORM[7]
    assert got["shape"].tolist() == [facts.literal_free(text)] * 50 and set(got["fingerprint"]) == {facts.fingerprint(text)}
    assert got["markers"].tolist() == [facts.markers(text)] * 50 and facts.markers(text) == ["leading-wildcard-like"]


def test_forms_keep_what_tools_tell_apart():
    one = lambda sql: sharing.form(sql)[0]
    assert one("select 12345 from t") == one("SELECT 67890\nfrom t".replace("SELECT", "select"))
    for a, b in (("n like '%a'", "n like 'a'"), ("d = '2024-01-01'", "d = '12345'"), ("a = 10000 and b = 10000", "a = 10000 and b = 20000"), ("a::varchar(12345)", "a::varchar(54321)"), ("f('day', d)", "f('year', d)")):
        assert one(f"select {a} from t") != one(f"select {b} from t")
    assert sharing.form("select ` from t") is None and sharing.form(f"select {sharing.MARK} from t") is None


@pytest.mark.parametrize("where", ["f.k = {0} and d.name = 'x{0}' and f.v > {0}", "date(f.event_date) = '2024-01-{1}' and f.v in ({0}, 2, '{0}')", "f.k = {0} and f.v between 9{0} and {0} and f.v < 10{0}", "f.k = 'it''s {0}' and d.name like '%{0}%' and f.k = 99{0}"])
def test_rewrites_and_stages_of_a_form_equal_those_of_each_statement(spark, where):
    catalog = {"db.s.f": rewrites.Meta(sortkeys=["event_date"], not_null={"k"}, columns=["k", "v", "event_date"], rows=5e9, size_mb=2e5), "db.s.d": rewrites.Meta(columns=["k", "name"])}
    texts = ["select f.v, d.name from s.f f join s.d d on f.k = d.k where " + where.format(k, k % 28 + 1) for k in (0, 5, 12345, 99999, 123456)] + ["insert into t values (1"]
    rows = spark.createDataFrame([(t,) for t in texts], "sql_text string")
    named = rows.selectExpr("sql_text", "sha2(sql_text, 256) as sql_hash")
    for r in batch.rewritten(rows, catalog).join(named, "sql_hash").collect():
        want = rewrites.optimized(r.sql_text, catalog)
        assert (r.sql, r.rules, r.blocked, r.error) == (want.sql, [n for n, _ in want.applied], [f"{n}: {w}" for n, w in want.blocked], want.error)
    for r in batch.staged(rows, catalog).join(named, "sql_hash").collect():
        want = stages.decomposed(r.sql_text, catalog)
        assert (r.script, r.error, r.gain) == (want.script, want.error, want.gain)


@pytest.mark.parametrize("tool", [rewrites.optimized, stages.decomposed])
def test_rewrites_and_stages_read_a_form_once(monkeypatch, tool):
    seen = _parses(monkeypatch)
    shared = sharing.Shared(lambda sql: tool(sql, {}))
    shared(SAME_FORM[0])
    once = len(seen)
    assert [shared(t)[1](shared(t)[0].sql if tool is rewrites.optimized else shared(t)[0].final) for t in SAME_FORM] and len(seen) == once


def test_enrichment_reads_what_waits_once_and_bounds_its_commits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(enrichment, "MOST_COMMITS", 3)
    store = storage.Store(spark, str(tmp_path / "store"))
    queries = spark.createDataFrame([(i, f"select a from s.t_{i} where v = {i}") for i in range(120)], "query_id int, sql_text string")
    files, commits = [], []

    def analyse(part):
        files.append(set(part.inputFiles()))
        return grouping.features(part)

    got, counts = enrichment.enriched(queries, store, 10, analyse, lambda done, of: commits.append((done, of)))
    assert commits == [(4, 12), (8, 12), (12, 12)] and counts == {"new": 120, "known": 0}
    assert len(files) == 3 and not (files[0] & files[1] or files[0] & files[2] or files[1] & files[2]), "a commit reads only its own statements"
    assert got.count() == 120 and store.read(enrichment.CACHE).select("namespace_id").distinct().count() == 12
    assert got.where("structure_key is null").count() == 0


def test_a_commits_statements_are_dealt_to_several_tasks(spark, tmp_path):
    queries = spark.createDataFrame([(i, f"select a from s.t_{i} where v = {i}") for i in range(200)], "query_id int, sql_text string")
    files = []

    def analyse(part):
        files.append(len(part.inputFiles()))
        return grouping.features(part)

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, counts = enrichment.enriched(queries, storage.Store(spark, str(tmp_path / "store")), 100, analyse)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert counts == {"new": 200, "known": 0} and len(files) == 2 and min(files) > 1


def test_places_meet_locations_without_their_queries(spark):
    kinds = "redshift_database_name string, s3_location string, external_table_key string"
    catalog = spark.createDataFrame([("DA", "s3://L/a/", "da.s.a"), ("db", "s3://l/a/", "db.s.a"), ("db", "s3://l/a/b/", "db.s.b")], kinds)
    places = spark.createDataFrame([("s3://l/a/b/part-1",), ("s3://l/a/b/part-1",), ("s3://x/",), ("",), (None,)], "place string")
    found = {(r["db"], r["place"]): r["external_table_key"] for r in assembly.by_location(places, catalog).collect()}
    assert found == {("da", "s3://l/a/b/part-1"): "da.s.a", ("db", "s3://l/a/b/part-1"): "db.s.b"}


def test_segments_of_one_name_and_place_are_matched_once(spark, monkeypatch):
    catalog = spark.createDataFrame([(1, "s", "a", "s3://l/a/"), (2, "s", "b", "s3://l/a/b/")], "ext_id int, schema_name string, table_name string, location string")
    rows = [(q, 1, name, place) for q in range(200) for name, place in (("S.a", "s3://x/y"), ("", "s3://l/a/b/part-1"), (None, "s3://l/a/c"), ("x", "s3://x/y"))]
    segments = spark.createDataFrame(rows, "query_id int, segment_id int, table_name string, file_location string")
    cut = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(external, "prefixes", F.udf(lambda p: (cut.add(1), ["/".join(p.split("/")[:n]) for n in range(p.count("/") + 1, 2, -1)])[1], "array<string>").asNondeterministic())
    found = {(r["table_name"], r["ext_id"], r["match_rank"]): r["n"] for r in external.matched(segments, catalog).groupBy("table_name", "ext_id", "match_rank").agg(F.count("*").alias("n")).collect()}
    assert found == {("S.a", 1, 0): 200, ("", 2, 3): 200, (None, 1, 3): 200, ("x", None, None): 200}
    assert 0 < cut.value <= 16, "a pair of name and place is cut once, not once for each segment"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flow_is_dealt_by_query_once(spark, sf):
    assert _plan(details.grouped_flow(flows.captured(spark, sf))).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("frame", [core.acts, core.report_summary])
def test_actions_and_summary_make_the_slow_queries_once(spark, sf, frame):
    leaves = frame(spark, sf)._jdf.queryExecution().optimizedPlan().collectLeaves()
    # orders are read four times for the slow queries that rules judge, as often for those behind the tables' impact, and once for references
    assert sum("o_orderkey" in leaves.apply(i).toString() for i in range(leaves.size())) <= 9


def test_only_text_of_a_fitting_form_is_cast(spark):
    """A failing cast costs an exception, so what has no fitting form is not cast."""
    texts = ["many", "n/a", "soon", "1.5x", "--1", "", " None ", "12", " 7 ", "\t8\n", "-2.5", "2.5", "1e3", ".5", "5.", "1.5d", "0x1p3", "inf", "99999999999999999999"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(exprs.whole("t"), exprs.real("t")).collect()
    nothing = [(None, None)] * 7
    numbers = [(12, 12.0), (7, 7.0), (8, 8.0), (-3, -2.5), (3, 2.5), (1000, 1000.0), (1, 0.5), (5, 5.0), (2, 1.5), (8, 8.0), (None, float("inf")), (None, 1e20)]
    assert [tuple(r) for r in got] == nothing + numbers
    days = spark.createDataFrame([("soon",), ("2024-01-02",), (" 2024-01-02 03:04",)], "t string").select(exprs.moment("t").cast("string")).collect()
    assert [r[0] for r in days] == [None, "2024-01-02 00:00:00", "2024-01-02 03:04:00"]
    for made, form in ((exprs.whole("t"), "[0-9]"), (exprs.real("t"), "inf"), (exprs.moment("t"), "[Tt]")):
        plan = rows.select(made)._jdf.queryExecution().optimizedPlan().toString()
        assert "RLIKE" in plan and form in plan


def test_typed_views_keep_generated_methods_short(spark, sf):
    layers.QUERIES["silver_external_table_info"](spark, sf)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_similar_statements_compare_each_shape_once(spark, monkeypatch):
    rows = [(i, f"select a, b from t where k = {i}" if i % 2 else f"select a, b, c from t where k = {i}") for i in range(200)] + [(500, "vacuum u"), (501, None)]
    q = spark.createDataFrame(rows, "query_id long, sql_text string")
    pairs, compared = spark.sparkContext.accumulator(0), grouping.pair_similarity

    def seen(p):
        return compared(p.mapInPandas(lambda batches: (pairs.add(len(b)) or b for b in batches), p.schema))

    monkeypatch.setattr(grouping, "pair_similarity", seen)
    got = grouping.similar_to("select a, b from t where k = 7", q, most=120).collect()
    assert pairs.value <= 3
    assert [r.query_id for r in got] == [*range(1, 200, 2), *range(0, 40, 2)] and got[0].similarity == 1.0
    assert got[0].sql_text == "select a, b from t where k = 1" and list(got[0].asDict()) == ["query_id", "sql_text", "right_shape", "left_shape", "similarity"]


def test_contained_references_are_found_around_dots(spark):
    keys = ["db.s.t", "db.s.t_1", "db.xs.t", "db.s.", "db..t", "db..", "plain", "a.b", "db.s.t"]
    tables = spark.createDataFrame([(i, k, float(i % 3)) for i, k in enumerate(keys)], "table_id long, table_key string, table_risk_score double")
    texts = ["select * from S.T_12", "s.t and s.t again, db.xs.t.c", "select plain", "a.b.", "..", ".t", "no dot", "", None, "s.t", "é.b aé.b", "xxs.", "b.a.b.c"]
    queries = spark.createDataFrame([(i % 12, t) for i, t in enumerate(texts)], "query_id long, sql_text string")
    found = gold.table_references_contained(queries, tables)
    want = sorted((i % 12, j) for i, t in enumerate(texts) for j, k in enumerate(keys) if ".".join(k.split(".")[-2:]) in (t or "").lower())
    assert sorted((r.query_id, r.table_id) for r in found.collect()) == want
    assert not gold.table_references_contained(queries, tables.limit(0)).count()


def test_contained_references_have_no_bound_on_tables(spark):
    tables = spark.range(2500).selectExpr("id as table_id", "concat('db.s.t', id) as table_key", "cast(id as double) as table_risk_score")
    queries = spark.createDataFrame([(1, "select 1 from s.t7 join s.t7 using (k)"), (1, "select 1 from s.t7 join s.t7 using (k)"), (1, "s.t2400"), (2, "S.T1")], "query_id long, sql_text string")
    found = gold.table_references_contained(queries, tables)
    assert sorted((r.query_id, r.table_id) for r in found.collect()) == [(1, 2), (1, 7), (1, 7), (1, 24), (1, 240), (1, 2400), (2, 1)]


def test_contained_references_do_not_compare_all_pairs(spark, sf):
    plan = core.QUERIES["table_references_contained"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join Inner" in x]
    assert any("tail" in x and "=" in x and "Contains" not in x for x in joins)


def test_forms_of_a_catalogue_are_dealt_and_never_broadcast(spark):
    cat = spark.createDataFrame([("db1", "s", "orders", ""), ("db2", "s", "orders", ""), ("db1", "s", "only", "")], "source_db string, schema_name string, table_name string, table_key string")
    said = spark.createDataFrame([("s.only", ""), ("s.orders", "db2"), ("orders", "db1")], "mention string, database_name string")
    found = triage.resolved_by_database(said, cat)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[way#\d+, form#\d+\]", plan) and "hashpartitioning(source_db" in plan
    assert {(r.mention, r.table_key) for r in found.collect()} == {("s.only", "db1.s.only"), ("s.orders", "db2.s.orders"), ("orders", None)}


def test_reports_sum_in_hash_aggregates(spark):
    rows = [(i, f"select a, b from s.t where v > {i % 3}", f"u{i % 2}", "db", "SELECT", float(i), 1.0, None if i == 1 else i) for i in range(4)]
    q = spark.createDataFrame(rows, "query_id long, sql_text string, user_name string, database_name string, query_type string, elapsed_s double, risk_score double, spill long")
    found = grouping.report(grouping.candidates(q), ["spill"], ["spill"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(?:ObjectHash|Sort)Aggregate\(keys=\[group_key#\d+\], functions=\[.*sum\(coalesce\(spill", plan)
    (g,) = found.collect()
    assert (g.total_spill, g.avg_spill, g.query_ids, g.user_count, g.query_count) == (5, 5 / 3, [0, 1, 2, 3], 2, 4)
