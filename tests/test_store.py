"""The store's versions: what a writer that dies, two writers, and a damaged copy leave."""

import pytest

from querytide.sources import storage


@pytest.fixture
def store(spark, tmp_path):
    return storage.Store(spark, f"file://{tmp_path}/store")


@pytest.fixture
def rows(spark):
    return lambda snapshot, *r: storage.stamped(spark.createDataFrame(list(r), "query_id string, v string, namespace_id string"), snapshot)


def held(store, table, version=None):
    return sorted((r.snapshot_id, r.namespace_id, r.query_id, r.v) for r in store.read(table, version).collect())


def staged(store, rows):
    for t in ("a", "b", "c"):
        store.replace(t, rows("s1", ("1", f"old {t}", "n1"), ("2", f"old {t}", "n2")))
        store.stage(t, rows("s1", ("9", f"new {t}", "n1")))


def test_promotion_changes_all_tables_in_one_version(store, rows):
    staged(store, rows)
    before = store.versions()
    assert store.promote("s1", ["a", "b", "c"]) == []
    assert len(store.versions()) == len(before) + 1
    for t in ("a", "b", "c"):
        assert held(store, t) == [("s1", "n1", "9", f"new {t}"), ("s1", "n2", "2", f"old {t}")]
        assert held(store, t, before[-1]) == [("s1", "n1", "1", f"old {t}"), ("s1", "n2", "2", f"old {t}")], "earlier versions stay readable"


@pytest.mark.parametrize("dies", ["between tables", "before the rename"])
def test_a_promotion_that_dies_leaves_the_old_state(store, rows, monkeypatch, dies):
    staged(store, rows)
    before = {t: held(store, t) for t in ("a", "b", "c")}
    if dies == "between tables":
        load = storage.Store.load
        monkeypatch.setattr(storage.Store, "load", lambda self, t, r: (_ for _ in ()).throw(RuntimeError("killed")) if t == "b" else load(self, t, r))
    else:
        monkeypatch.setattr(storage.Files, "publish", lambda self, *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        store.promote("s1", ["a", "b", "c"])
    monkeypatch.undo()
    again = storage.Store(store.spark, store.root)
    assert {t: held(again, t) for t in ("a", "b", "c")} == before
    assert again.promote("s1", ["a", "b", "c"]) == [], "and it can be run again"
    assert ("s1", "n1", "9", "new c") in held(again, "c")


def test_one_foreign_or_missing_table_refuses_the_promotion(store, rows):
    staged(store, rows)
    store.stage("b", rows("s2", ("9", "x", "n1")))
    assert store.promote("s1", ["a", "b", "lost"]) == ["b", "lost"]
    assert held(store, "a") == [("s1", "n1", "1", "old a"), ("s1", "n2", "2", "old a")]


def test_of_two_writers_from_one_version_the_second_fails(store, rows):
    store.replace("a", rows("s1", ("1", "x", "n1")))
    base = store.manifest()
    mine, other = store.load("a", rows("s1", ("2", "mine", "n1"))), store.load("a", rows("s1", ("3", "other", "n1")))
    store.commit(base, {"a": mine})
    with pytest.raises(storage.Conflict):
        store.commit(base, {"a": other})
    assert held(store, "a") == [("s1", "n1", "2", "mine")]
    assert not store.files.matching(f"{store.root}/_manifest/_*.json")


def test_slices_keep_text_keys_and_tables_gain_columns(store, rows):
    store.replace("a", rows("007", ("1", "x", "01"), ("2", "y", "a/b=c")))
    store.replace("a", rows("008", ("3", "z", "01")).withColumn("extra", storage.F.lit(5)))
    assert held(store, "a") == [("007", "01", "1", "x"), ("007", "a/b=c", "2", "y"), ("008", "01", "3", "z")]
    assert sorted(r.extra or 0 for r in store.read("a").collect()) == [0, 0, 5]


def test_a_damaged_copy_is_refused_before_anything_changes(store, rows, tmp_path, spark):
    copy = f"file://{tmp_path}/copy"
    for t in ("a", "b"):
        store.replace(t, rows("s1", ("1", "x", "n1"), ("2", "y", "n2")))
    assert store.backup(copy, ["a", "b"]) == {"a": 2, "b": 2}
    store.replace("a", rows("s1", ("7", "later", "n1")))
    rows("s1", ("1", "x", "n1"), ("2", "CHANGED", "n2")).write.mode("overwrite").parquet(f"{copy}/b")  # as many rows, other values
    before = held(store, "a")
    with pytest.raises(ValueError, match="copy of b"):
        store.restore(copy, ["a", "b"])
    assert held(store, "a") == before
    assert store.restore(copy, ["a"]) == {"a": 2} and held(store, "a") == held(store, "b")


def test_expired_versions_and_loads_go(store, rows):
    for v in "xyz":
        store.replace("a", rows("s1", ("1", v, "n1")))
    store.load("a", rows("s1", ("1", "never committed", "n1")))
    assert store.expire(keep=1) == 3
    assert store.versions() == [3] and held(store, "a") == [("s1", "n1", "1", "z")]
    with pytest.raises(ValueError, match="no version 1"):
        store.read("a", 1)
