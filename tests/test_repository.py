"""The kept catalogue, targeted reads, and enrichment that goes on after a kill."""

import pytest
from pyspark.sql import functions as F

from querytide.operators import enrichment
from querytide.sources import repository, storage

TABLES = [("DB1", "s", "orders", 1), ("db2", "s", "orders", 2), ("db1", "s", '"Only"', 3), ("db2", "t", "twice", 4), ("db2", "u", "twice", 5)]


@pytest.fixture
def made(spark, tmp_path):
    store = storage.Store(spark, f"file://{tmp_path}/store")
    return store, repository.Repository(store)


def tables(spark, rows=TABLES):
    return spark.createDataFrame(rows, "database_name string, schema_name string, table_name string, size_mb int")


def columns(spark):
    return spark.createDataFrame([("db1", "s", "orders", "b", "int", 0), ("db1", "s", "orders", "z", "int", 1), ("db1", "s", "orders", "a", "int", 0), ("db2", "s", "orders", "x", "int", 0)], "database_name string, schema_name string, table_name string, column_name string, data_type string, sortkey_pos int")


def refs(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "identity string")


def test_build_get_find_and_stats(spark, made):
    store, repo = made
    assert repo.build(tables(spark), columns(spark)) == 1
    assert repo.stats() == {"databases": 2, "tables": 5, "columns": 4}
    (got,) = repo.get("db1", "s", "orders").collect()
    assert (got.table_key, got.size_mb, [c.column_name for c in got.columns]) == ("db1.s.orders", 1, ["z", "a", "b"])
    assert sorted(r.table_key for r in repo.find(table="orders").collect()) == ["db1.s.orders", "db2.s.orders"]
    assert sorted(r.size_mb for r in repo.find(database="db2").collect()) == [2, 4, 5] and repo.find().count() == 5


@pytest.mark.parametrize(("default", "want"), [("", [None, "db1.s.only", "db1.s.only", "db2.s.orders", None, None, None]), ("db1", ["db1.s.orders", "db1.s.only", "db1.s.only", "db2.s.orders", None, None, None]), ("DB2", ["db2.s.orders", "db1.s.only", "db1.s.only", "db2.s.orders", None, None, None])])
def test_references_resolve(spark, made, default, want):
    _, repo = made
    repo.build(tables(spark), columns(spark))
    names = ["S.Orders", "only", "s.only", "db2.s.orders", "twice", "db9.s.orders", None]
    got = {r.identity: r.table_key for r in repo.resolve(refs(spark, *names), default).collect()}
    assert [got[n] for n in names] == want
    found, missing = repo.catalog_for(refs(spark, "only", "lost", "only"), default)
    assert [r.table_key for r in found.collect()] == ["db1.s.only"] and [r.identity for r in missing.collect()] == ["lost"]


def test_upserts_write_through_and_versions_stay(spark, made):
    _, repo = made
    first = repo.build(tables(spark), columns(spark))
    second = repo.upsert(tables(spark, [("db1", "s", "orders", 10), ("db3", "s", "new", 11)]), columns(spark).where("column_name = 'b'"))
    assert second > first
    sizes = lambda v=None: {r.table_key: r.size_mb for r in repo.find(version=v).collect()}
    assert sizes()["db1.s.orders"] == 10 and sizes()["db3.s.new"] == 11 and sizes()["db1.s.only"] == 3 and len(sizes()) == 6
    assert sizes(first)["db1.s.orders"] == 1 and len(sizes(first)) == 5
    assert [c.column_name for c in repo.get("db1", "s", "orders").first().columns] == ["b"], "its columns were replaced with it"
    assert repo.resolve(refs(spark, "new")).first().table_key == "db3.s.new"


def test_only_missing_names_are_asked_of_the_live_catalogue(spark, made):
    _, repo = made
    repo.build(tables(spark), columns(spark))
    asked = []

    def live(names):
        asked.extend(r[0] for r in names.collect())
        return tables(spark, [("db7", "s", n, 7) for n in ("fresh",)]), columns(spark).limit(0)

    got = {r.identity: (r.table_key, r.origin) for r in repo.fetch(refs(spark, "only", "fresh", "x.y.lost", "only"), live).collect()}
    assert got == {"only": ("db1.s.only", "repository"), "fresh": ("db7.s.fresh", "live"), "x.y.lost": (None, None)}
    assert sorted(asked) == ["fresh", "lost"]


def test_names_reach_the_scan(spark, tmp_path):
    spark.range(1000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("table_name")).repartitionByRange(4, "table_name").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    found = repository.for_names(rows, "table_name", spark.createDataFrame([("t5",), ("t77",), ("none",), (None,)], "n string"))
    assert sorted(r[0] for r in found.collect()) == ["t5", "t77"]
    assert "PushedFilters: [In(table_name, [none,t5,t77])]" in found._jdf.queryExecution().executedPlan().toString().replace("`", "")


def test_more_names_than_a_predicate_may_hold_are_joined(spark, monkeypatch):
    monkeypatch.setattr(repository, "MOST_NAMES", 2)
    rows = spark.createDataFrame([(n,) for n in "abcd"], "table_name string")
    found = repository.for_names(rows, "table_name", spark.createDataFrame([(n,) for n in "abcab"], "n string"))
    assert sorted(r[0] for r in found.collect()) == ["a", "b", "c"] and "Join" in found._jdf.queryExecution().executedPlan().toString()


def test_predicates_of_live_reads():
    assert repository.name_predicates('"table"', ["B", "a'x", "a'x", "", None, "c"], 2, "x = 1") == ["LOWER(\"table\") IN ('a''x', 'b') AND x = 1", "LOWER(\"table\") IN ('c') AND x = 1"]
    assert repository.name_predicates("t", []) == []


def test_a_killed_enrichment_goes_on_from_its_last_batch(spark, made):
    store, _ = made
    queries = spark.createDataFrame([(i, f"select a_{'x' * (i % 40)} from s.t_{'y' * (i % 40)} where v = {i % 40}") for i in range(80)] + [(99, None)], "query_id int, sql_text string")
    seen = spark.sparkContext.accumulator(0)

    def analyse(part):
        seen.add(part.count())
        return enrichment.features(part)

    def dies(done, of):
        assert of == 4
        if done == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        enrichment.enriched(queries, store, 10, analyse, dies)
    half = store.read(enrichment.CACHE).count()
    assert 0 < half < 40 and seen.value == half
    got, counts = enrichment.enriched(queries, store, 10, analyse)
    assert counts == {"new": 40 - half, "known": half} and seen.value == 40, "no statement is analysed twice"
    assert got.count() == 80 and got.select("sql_hash").distinct().count() == 40
    want = {r.query_id: r.asDict() for r in enrichment.features(enrichment.keyed(queries)).collect()}
    assert all(r.asDict()[c] == want[r.query_id][c] for r in got.collect() for c in want[0] if c not in ("query_id",))
    _, counts = enrichment.enriched(queries, store, 10, analyse)
    assert counts == {"new": 0, "known": 40} and seen.value == 40
