"""The SQL reader and the statement tools."""

import pytest

from querytide.plans.statement import facts, lens, rewrites, stages, tree, views

M = rewrites.Meta
CATALOG = {
    "db.s.f": M(sortkeys=["event_date"], not_null={"id"}, columns=["id", "event_date", "k", "v"], rows=5e6, size_mb=9000, distkey="k"),
    "db.s.d": M(columns=["k", "name", "fid"], not_null={"fid"}, size_mb=2),
}
COLUMNS = {k: m.columns for k, m in CATALOG.items()}
VIEWS = {"s.v": "select f.k as kk, f.v from s.f f join s.d d on f.k = d.k", "s.w": "select kk from s.v", "s.loop": "select * from s.loop"}

READ = [
    "select a, b as c from s.t x join u using (id) where x.a = 1 and not (b > 2 or c is not null) group by a having count(*) > 1 order by 1 desc nulls last limit 5",
    "with w as (select distinct a from t where d between '2020-01-01' and date '2020-02-01') select w.*, case when a > 1 then 'x' else 'y' end from w left join (select * from q) z on w.a = z.a::varchar(10)",
    "select sum(x) over (partition by y order by z rows between 1 preceding and current row) from t2 where a not in (select b from c) and exists (select 1 from d)",
    "select extract(year from ts), left(a, 3), -x * (y + 1) - (2 - 1) from a, b where a.id = b.id and name ilike '%x' and k in (1,2,3)",
    'select top 5 "Odd Name" from t union all (select 1 from u order by 1 limit 2) order by 1',
    "select a from t qualify row_number() over (order by b) = 1",
]


@pytest.mark.parametrize("text", READ)
def test_text_reads_back(text):
    once = tree.sql(tree.parse(text))
    assert tree.sql(tree.parse(once)) == once


@pytest.mark.parametrize("text", ["select", "select a from", "insert into t values (1)", "select a from t where", "select 'open", "with recursive r as (select 1) select * from r", "select a from t offset 3"])
def test_what_is_not_understood_is_refused(text):
    with pytest.raises(SyntaxError):
        tree.parse(text)


@pytest.mark.parametrize("other", ["SELECT a FROM t WHERE d = '2021-05-05' AND k IN (7)", "select a /* c */ from T\n where d='x' and k in (1, 2,3)"])
def test_literals_lists_comments_and_case_do_not_matter(other):
    assert facts.literal_free("select a from t where d = '2020-01-01' and k in (1, 2)") == facts.literal_free(other) or "(7)" in other


def test_order_and_aliases_do_not_matter_to_the_fingerprint():
    a = facts.fingerprint("select x.a, x.b from t x where x.a = 1 and x.b = 2")
    assert a == facts.fingerprint("SELECT y.b, y.a FROM t y WHERE y.b = 5 AND 7 = y.a")
    assert a != facts.fingerprint("select x.a from t2 x where x.a = 1 and x.b = 2")
    assert facts.fingerprint("vacuum 't1'") == facts.fingerprint("VACUUM  't2'")


def test_features():
    f = facts.features("select o.a, count(*) from s.o o join s.c c on o.cid = c.id where o.d > 1 and c.n like 'x%' group by o.a order by 2")
    assert f["tables"] == ["s.c", "s.o"] and f["join_columns"] == ["cid", "id"] and f["filter_columns"] == ["d", "n"] and f["join_count"] == 1
    assert f["predicate_ops"] == [">", "like"] and f["group_columns"] == ["a"]
    assert facts.features("select 1 from a, b where a.x = b.y")["join_columns"] == ["x", "y"]


def test_markers():
    meta = {"s.f": {"size_mb": 9000, "distkey": "k", "sortkey": "d", "stats_off": 20, "unsorted_pct": 30, "skew_rows": 5}}
    found = facts.markers("select * from s.f f join s.g g on f.x = g.x where date(f.d) = '2020-01-01' and g.n like '%a'", meta)
    assert set(found) == {"select-star", "leading-wildcard-like", "join-off-distkey", "join-off-sortkey", "func-on-sortkey", "stale-stats", "heavily-unsorted", "data-skew"}
    assert "cross-join" in facts.markers("select a from t cross join u") and "cross-join" not in facts.markers("select a from t, u where t.x = u.x")
    assert "hidden-view-joins" in facts.markers("select kk from s.v", views=VIEWS)


def test_decomposability():
    assert facts.decomposability("select a from s.t where b = 1") == (1.0, [])
    score, why = facts.decomposability("select * from a, b where exists (select 1 from c where c.x = a.x)")
    assert score < 0.6 and {"star", "cross join", "correlated subquery"} <= set(why)
    assert facts.decomposability("delete from t")[1] == ["not a query"] and facts.decomposability("with recursive r as (select 1) select 1")[1] == ["recursive"]


def test_facts_of_long_and_of_unparsed_statements(spark):
    long = "select f.*, g.a from s.f f join s.g g on f.k = g.k where g.n like '%x' and f.d in (" + ", ".join(map(str, range(3000))) + ")"
    deep = "select * from s.f where " + " or ".join(f"a = {i}" for i in range(3000))
    texts = {
        "long": long,
        "long_insert": "insert into s.t " + long,
        "deep": deep,
        "unload": "unload ('" + "select a from s.f where k in (" + ", ".join(f"''v{i}''" for i in range(4000)) + ")') to 's3://b/1'",
        "literal": "insert into s.t values ('" + "x" * 30000 + "')",
        "insert": "insert into s.t select distinct x.*, b * 2 from s.f x cross join s.g",
        "update": "update s.t set a = 1 from s.u u where u.k = 2 and u.n like '%z'",
        "recursive": "with recursive r (n) as (select 1 union all select n from r join s.f on n = k) select * from r",
        "offset": "select a from s.f where a in (select b from s.g) offset 3",
    }
    assert len(long) > facts.MOST_CHARS
    rows = spark.createDataFrame(list(texts.items()), "name string, sql_text string")
    named = rows.selectExpr("name", "sha2(sql_text, 256) as sql_hash")
    got = {r.name: r for r in facts.analysed(rows).join(named, "sql_hash").collect()}
    f, r = facts.features(long), got["long"]
    assert (r.method, r.tables, r.join_columns, r.filter_columns) == ("regex-oversize", ["s.f", "s.g"], f["join_columns"], f["filter_columns"])
    assert [r.join_count, r.predicate_count, r.subquery_count, r.wildcard_count] == [f[f"{c}_count"] for c in ("join", "predicate", "subquery", "wildcard")]
    assert r.markers == facts.markers(long) != [] and r.decomposability == facts.decomposability(long)[0] > 0
    plain = {k: (r.method, r.tables, r.join_count, r.subquery_count, r.wildcard_count, r.markers, r.decomposability) for k, r in got.items() if k != "long"}
    assert plain == {
        "long_insert": ("regex-oversize", ["s.f", "s.g", "s.t"], 1, 0, 1, ["select-star", "leading-wildcard-like"], 0.05),
        "unload": ("regex-oversize", ["s.f"], 0, 0, 0, [], 1.0),
        "literal": ("regex-oversize", ["s.t"], 0, 0, 0, [], 0.05),
        "deep": ("regex-oversize", ["s.f"], 0, 0, 1, ["select-star"], 0.3),
        "insert": ("regex", ["s.f", "s.g", "s.t"], 1, 0, 1, ["select-star", "cross-join", "distinct"], 0.05),
        "update": ("regex", ["s.t", "s.u"], 0, 0, 0, ["leading-wildcard-like"], 0.05),
        "recursive": ("regex", ["s.f"], 1, 1, 1, ["select-star"], 0.1),
        "offset": ("regex", ["s.f", "s.g"], 0, 1, 0, [], 0.3),
    }
    assert got["update"].predicate_count == 2


def test_procedure_statements():
    body = "begin insert into t values ('a;b'); -- x; y\n update t set a = $$;$$; if x > 1 then delete from t; end if; perform f(); end;"
    assert facts.statements(body) == ["insert into t values ('a;b')", "update t set a = $$;$$", "delete from t"]


def test_view_expansion_and_footprint():
    text, used = views.exploded("select kk from s.w", VIEWS)
    assert used == ["s.w", "s.v"] and sorted(t.key for t in tree.tables(tree.parse(text))) == ["s.d", "s.f"]
    assert views.exploded("select * from s.loop", VIEWS)[0] == "select * from (select * from s.loop) loop"
    text, spans = views.exploded_text("select kk from s.w q where 1 = 1", VIEWS)
    assert text.startswith("select kk from (select kk from (select f.k") and text.endswith("q where 1 = 1") and len(spans) == 2
    assert ("s.f", "table", "s.w>s.v", 2) in views.footprint("select kk from s.w", VIEWS)


def test_lineage_through_ctes_stars_views_and_subqueries():
    O = views.Origin  # noqa: E741, N806
    got = views.lineage("with w as (select k, v * 2 as vv from s.f) select w.k, vv, (select max(name) from s.d) as m, d.* from w join s.d d on d.k = w.k", COLUMNS)
    assert got["vv"] == {O("db.s.f", "v")} and got["m"] == {O("db.s.d", "name")} and got["fid"] == {O("db.s.d", "fid")}
    assert views.lineage("select kk from s.w", COLUMNS, VIEWS)["kk"] == {O("db.s.f", "k")}
    assert views.lineage("select k from s.f union all select fid from s.d", COLUMNS)["k"] == {O("db.s.f", "k"), O("db.s.d", "fid")}


@pytest.mark.parametrize(
    ("text", "rule", "part"),
    [
        ("select v from s.f where date(event_date) = '2024-01-31'", "SARGABLE_SORTKEY", "event_date < '2024-02-01'"),
        ("select v from s.f where cast(event_date as date) = '2024-01-31'", "SARGABLE_SORTKEY", "event_date >= '2024-01-31'"),
        ("select v from s.f where date_trunc('day', event_date) = date '2024-12-31'", "SARGABLE_SORTKEY", "event_date < '2025-01-01'"),
        ("select v from s.f where extract(year from event_date) = 2024", "SARGABLE_SORTKEY", "event_date < '2025-01-01'"),
        ("select f.v from s.f f where f.id not in (select x.fid from s.d x)", "NOT_IN_TO_NOT_EXISTS", "not exists (select 1 from s.d x where x.fid = f.id)"),
        ("select distinct k, sum(v) from s.f group by k", "REDUNDANT_DISTINCT", "select k, sum(v)"),
        ("select f.v from s.f f join s.d d on f.k = d.k where f.k = 3", "PROPAGATE_JOIN_FILTER", "d.k = 3"),
        ("select f.v from s.f f join s.d d on f.k = d.k where d.k in (1, 2)", "PROPAGATE_JOIN_FILTER", "f.k in (1, 2)"),
    ],
)
def test_rewrites_apply(text, rule, part):
    got = rewrites.optimized(text, CATALOG)
    assert rule in [n for n, _ in got.applied] and part in got.sql
    assert tree.sql(tree.parse(got.sql)) == got.sql


@pytest.mark.parametrize(
    "text",
    [
        "select v from s.f where date(id) = '2024-01-31'",
        "select d.name from s.d d where d.k not in (select f.v from s.f f)",
        "select distinct k from s.f group by k, v",
        "select f.v from s.f f left join s.d d on f.k = d.k where f.k = 3",
        "select v from s.f where event_date = '2024-01-31'",
        "select 'unfinished",
    ],
)
def test_rewrites_leave_alone(text):
    got = rewrites.optimized(text, CATALOG)
    assert got.applied == [] and got.sql == text


def test_decomposition_prunes_pushes_and_keys(spark):
    plan = stages.decomposed("select f.v, d.name from s.f f join s.d d on f.k = d.k where f.event_date > '2024-01-01' and d.name = 'x'", CATALOG)
    assert [s.table for s in plan.stages] == ["s.f"]
    s = plan.stages[0]
    assert (s.columns, s.filters, s.distkey, s.sortkey) == (["event_date", "k", "v"], ["event_date > '2024-01-01'"], "k", "event_date")
    assert "from stage_1_f f" in plan.final and plan.gain > 20
    assert not stages.decomposed("select d.name from s.d d", CATALOG).stages
    spark.createDataFrame([("2024-01-02", 1, 10), ("2023-01-02", 1, 20), ("2024-01-03", 2, 30)], "event_date string, k int, v int").createOrReplaceTempView("f")
    spark.createDataFrame([(1, "x"), (2, "y")], "k int, name string").createOrReplaceTempView("d")
    plan = stages.decomposed("select f.v, d.name from f join d on f.k = d.k where f.event_date > '2024-01-01' and d.name = 'x'", {"f": CATALOG["db.s.f"], "d": CATALOG["db.s.d"]})
    assert [tuple(r) for r in stages.run(spark, plan).collect()] == [(10, "x")]


def test_outer_joined_sources_keep_their_filters():
    plan = stages.decomposed("select d.name from s.d d left join s.f f on f.k = d.k where f.v = 1", CATALOG)
    assert plan.stages[0].filters == []


def test_coverage_and_objects():
    text = "with w as (select 1 from s.f) select * from w join x.unknown u on 1 = 1"
    assert stages.objects(text) == ["x.unknown", "s.f"] and stages.objects(text, True)[-1] == "w"
    assert stages.coverage(text, CATALOG) == {"known": ["s.f"], "missing": ["x.unknown"]}


def test_lens():
    text = "select * from s.f f join s.d d on f.k = d.k where date(f.event_date) = '2024-01-01'"
    assert [j["verdict"] for j in lens.joins(text, CATALOG)] == ["large misaligned"]
    assert [p["sortkey"] for p in lens.predicates(text, CATALOG)] == ["wrapped"]
    steps = lens.first_steps(text, CATALOG)
    assert steps[0].startswith("Align") and "List the columns" in steps
    nodes, edges = lens.diagram("select kk from s.w", CATALOG, VIEWS)
    assert ("s.w", "view") in nodes and ("s.f", "table") in nodes and edges == []
    assert lens.equality_colors(text, CATALOG) == [("f.k", "red"), ("d.k", "green")]
    assert lens.token_at("select a.b from t", 8) == "a.b" and lens.comparison_at("where a.x = 3", 10) == ("a.x", "3")


def test_similarity_of_parsed_and_unparsed_statements(spark):
    from querytide.operators.grouping import indel_ratio
    from querytide.plans.statement import similarity as S

    a, b = "select x.a, x.b from s.f x join s.d d on x.k = d.k where x.v > 5", "select x.a, x.c from s.f x where x.v > 7"
    p, q = S.prepared(a, a), S.prepared(b, b)
    j = S.jaccard
    expect = 0.25 * indel_ratio(p.text, q.text) + 0.22 * indel_ratio(p.tree, q.tree) + 0.10 * j(p.tokens, q.tokens) + 0.05 * j(p.pairs, q.pairs) + 0.09 * 0.5 + 0.07 * (2 / 5) + 0.04 * 0 + 0.03 * 1 + 0.06 * 0 + 0.05 * 1 + 0.04 * (1 / 3)
    assert p.tree and abs(S.similarity(p, q) - expect) < 1e-4 and S.similarity(p, p) == 1.0
    u, v = S.prepared("merge into t using s on 1", "merge into t using s on ?"), S.prepared("merge into t using r on 1", "merge into t using r on ?")
    assert not u.tree and abs(S.similarity(u, v) - (0.55 * indel_ratio(u.text, v.text) + 0.30 * j(u.tokens, v.tokens) + 0.15 * j(u.pairs, v.pairs))) < 1e-4
    assert S.similarity(S.prepared("", ""), p) == 0.0
    rows = spark.createDataFrame([(1, a), (2, a.replace("5", "9")), (3, "update t set a = 1"), (4, None), (5, b)], "query_id long, sql_text string")
    got = [(r.query_id, r.similarity) for r in S.alike(a, rows, least=0.5).collect()]
    assert [g[0] for g in got] == [1, 2, 5] and got[0][1] == got[1][1] == 1.0
