"""Merged reports and scopes that fall back."""

from dataclasses import replace

import pytest

from querytide.operators import grouping, reports


@pytest.fixture
def frame(spark):
    return lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_reloaded_empty_area_clears_and_others_keep(frame):
    base = reports.Report("db", {"insights": frame(1), "table_review": frame(2), "external_tables": frame(3), "own": frame(4), "table_status": frame(5)}, frozenset({"insights"}), "s", summary={"a": 1, "b": 1}, notes=("x",))
    update = reports.Report("db", {"insights": frame(), "table_review": frame(), "own": frame(6), "table_status": frame(), "rewrites": frame(7)}, frozenset({"insights", "external_tables"}), "", summary={"b": 2}, rule_count=9, notes=("y", "x"))
    got = reports.merged(base, update)
    assert {k: ids(v) for k, v in got.frames.items()} == {"insights": [], "table_review": [2], "external_tables": [3], "own": [6], "table_status": [], "rewrites": [7]}
    assert (got.snapshot, got.areas, got.summary, got.notes, got.rule_count) == ("s", {"insights", "external_tables"}, {"a": 1, "b": 2}, ("x", "y"), 9)


def test_nothing_comes_from_another_source_snapshot_or_scope(frame):
    base = reports.Report("db", {"insights": frame(1)}, snapshot="s", scope=("n",))
    update = reports.Report("db", {"rewrites": frame(2)}, snapshot="s", scope=("n",))
    assert set(reports.merged(base, update).frames) == {"insights", "rewrites"}
    for other in (replace(update, source="x"), replace(update, snapshot="t"), replace(update, scope=())):
        assert reports.merged(base, other) is other
    assert reports.merged(None, update) is update


def test_the_ledger_has_three_states(frame):
    report = reports.Report("db", {"insights": frame(), "rewrites": frame(1), "own": frame()}, frozenset({"insights"}))
    got = {r.frame: (r.state, r.trusted) for r in reports.ledger(report).collect()}
    assert got["insights"] == ("empty", True) and got["rewrites"] == ("rows", False) and got["own"] == ("empty", False)
    assert got["table_impact"] == ("absent", False) and got["table_status"] == ("absent", True)
    assert len(got) == len(reports.AREAS) + 1


def test_rows_or_evaluates_the_branch_in_the_plan(frame):
    assert ids(reports.rows_or(frame(1, 2), frame(3))) == [1, 2]
    assert ids(reports.rows_or(frame(), frame(3, 3))) == [3, 3]
    assert ids(reports.rows_or(frame(), frame())) == []


QUERIES = [(1, "SELECT a FROM t WHERE long = 1", "u"), (2, "select a  from t where LONG = 1", "v"), (3, "select a from t where long = 1", ""), (4, "other", "u"), (5, "  ", "u"), (6, None, None)]


@pytest.mark.parametrize(("least", "kept", "prefiltered"), [(3, [1, 2, 3], True), (4, [1, 2, 3, 4, 5, 6], False)])
def test_repeating_or_all(spark, least, kept, prefiltered):
    q = spark.createDataFrame(QUERIES, "query_id int, sql_text string, user_name string")
    got = grouping.repeating_or_all(q, least).collect()
    assert sorted(r.query_id for r in got) == kept and {r.prefiltered for r in got} == {prefiltered}
    assert [r.query_id for r in grouping.repeating(q, least).orderBy("query_id").collect()] == (kept if prefiltered else [])
    assert grouping.repeating_or_all(q.limit(0), least).count() == 0


def test_the_fallback_adds_no_scan(spark, tmp_path):
    spark.createDataFrame(QUERIES, "query_id int, sql_text string, user_name string").write.parquet(f"{tmp_path}/q")

    def scans(f):
        """Scans of the final plan, without those below an exchange that is used again."""
        found = f(spark.read.parquet(f"{tmp_path}/q"))
        found.collect()
        text = found._jdf.queryExecution().executedPlan().toString()
        return text.count("Scan parquet"), text.count("ReusedExchange"), text

    _, _, plain = scans(lambda q: grouping.repeating(q, 3))
    _, reused, text = scans(lambda q: grouping.repeating_or_all(q, 3))
    assert "Subquery" in text and "ReusedExchange" in text
    assert reused > plain.count("ReusedExchange"), "the subquery reads the counts' exchanges, not the table"
