"""Queries over merged reports and scopes that fall back."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import enrichment, evidence, grouping, reports
from ..sources import repository, storage
from ..sources.adapter import relation, with_
from . import groups

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


# A base report and a later load of some of its areas. Of each frame: (base, update) as (relation, id, value, condition); None: not in that report.
_LOADED = ("slow_queries", "insights", "external_tables")
_ALL, _NONE = "true", "1 = 0"
_FRAMES: dict[str, tuple] = {
    "slow_queries": (("history", "query_id", "elapsed_time", _ALL), ("history", "query_id", "queue_time", "query_id % 2 = 0")),  # loaded, rows
    "query_explain": (("plans", "query_id", "plan_node_id", _ALL), ("plans", "query_id", "plan_node_id", _NONE)),  # loaded, empty
    "insights": (("history_all", "query_id", "elapsed_time", _ALL), ("history_all", "query_id", "elapsed_time", _NONE)),  # loaded, empty
    "external_tables": (("externals", "ext_id", "partition_keys", _ALL), None),  # loaded, absent
    "table_review": (("tables", "table_id", "size_mb", _ALL), ("tables", "table_id", "size_mb", _NONE)),  # not loaded, empty
    "table_impact": (("tables", "table_id", "stats_off", _ALL), ("tables", "table_id", "skew_rows", "table_id % 3 = 1")),  # not loaded, rows
    "table_status": (("users", "user_id", "user_id", _ALL), ("users", "user_id", "user_id", _NONE)),  # comes with every load
    "repeat_groups": (("segments", "query_id", "duration", _ALL), None),  # not loaded, absent
    "action_queue": (None, ("steps", "query_id", "duration", _ALL)),  # only in the update
    "own_frame": (("scans", "query_id", "input_rows", _ALL), ("scans", "query_id", "input_rows", _NONE)),  # of no known area
}
_RELATIONS = tuple(dict.fromkeys(side[0] for pair in _FRAMES.values() for side in pair if side))


def report_pair(spark, sf: str) -> tuple[reports.Report, reports.Report]:
    def frame(side: tuple) -> DataFrame:
        name, key, value, condition = side
        return relation(spark, sf, name).where(condition).select(F.col(key).cast("long").alias("id"), F.col(value).cast("long").alias("v"))

    base, update = ({k: frame(pair[i]) for k, pair in _FRAMES.items() if pair[i]} for i in (0, 1))
    return reports.Report("store", base, frozenset({"table_review", "slow_queries"}), "s1", ("ns0",)), reports.Report("store", update, frozenset(_LOADED), "s1", ("ns0",))


def _side(side: tuple) -> str:
    name, key, value, condition = side
    return f"select cast({key} as bigint) as id, cast({value} as bigint) as v from {name} where {condition}"


def _merged_sql(name: str, case: str) -> str:
    base, update = _FRAMES[name]
    if case != "merged":
        rows = _side(update) if update else None
    elif base is None or (update and (name == "table_status" or set(reports.AREAS.get(name, ())) & set(_LOADED))):
        rows = _side(update)
    elif update is None:
        rows = _side(base)
    else:
        rows = f"{_side(update)} union all select * from ({_side(base)}) where not exists ({_side(update)})"
    agg = "count(*) as n, min(id) as first_id, max(id) as last_id, cast(sum(v) as bigint) as total"
    return f"select '{case}' as merge_case, '{name}' as frame, {agg} from ({rows})" if rows else ""


_CASES = ("merged", "other_snapshot", "other_scope")


@query("report_merge", f"{with_(*_RELATIONS)} " + " union all ".join(x for case in _CASES for name in _FRAMES if (x := _merged_sql(name, case))))
def report_merge(spark, sf):
    base, update = report_pair(spark, sf)
    found = {"merged": reports.merged(base, update), "other_snapshot": reports.merged(base, replace(update, snapshot="s2")), "other_scope": reports.merged(base, replace(update, scope=("ns1",)))}
    out = None
    for case, report in found.items():
        for name, frame in report.frames.items():
            row = frame.agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("v").alias("total")).select(F.lit(case).alias("merge_case"), F.lit(name).alias("frame"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def _state_sql(name: str) -> str:
    side = _FRAMES.get(name, (None, None))[1]
    trusted = name == "table_status" or bool(set(reports.AREAS.get(name, ())) & set(_LOADED))
    state = f"case when exists ({_side(side)}) then 'rows' else 'empty' end" if side else "'absent'"
    return f"select '{name}' as frame, {state} as state, {str(trusted).lower()} as trusted"


@query("report_ledger", f"{with_(*_RELATIONS)} " + " union all ".join(_state_sql(x) for x in [*reports.AREAS, "own_frame"]))
def report_ledger(spark, sf):
    return reports.ledger(report_pair(spark, sf)[1])


_RUNS = r"""n as (select *, trim(regexp_replace(lower(sql_text), '\s+', ' ', 'g')) as norm from stated),
c as (select query_id, case when norm <> '' then count(*) over (partition by norm) else 0 end as text_runs, case when norm <> '' and trim(user_name) <> '' then count(*) over (partition by lower(trim(user_name)), left(norm, 64), right(norm, 64)) else 0 end as affix_runs from n)"""
_OR_ALL = "select '{case}' as scope_case, query_id, text_runs, affix_runs, (select coalesce(max(greatest(text_runs, affix_runs)), 0) >= {least} from c) as prefiltered from c where greatest(text_runs, affix_runs) >= {least} or not (select coalesce(max(greatest(text_runs, affix_runs)), 0) >= {least} from c)"
_MANY = 1_000_000_000


@query("repeating_or_all", f"{with_('history', 'statements')}, {groups.STATED}, {_RUNS} {_OR_ALL.format(case='some', least=3)} union all {_OR_ALL.format(case='none', least=_MANY)}")
def repeating_or_all(spark, sf):
    q = groups.stated(spark, sf)
    some, none = (grouping.repeating_or_all(q, least).select(F.lit(case).alias("scope_case"), "query_id", "text_runs", "affix_runs", "prefiltered") for case, least in (("some", 3), ("none", _MANY)))
    return some.unionByName(none)


# Two joins a query: one names a condition and tables that some nodes hold, the other only words
_JOINS = """select query_id, 1 as join_no, 'Filter: (x = 1)' as condition, 'a.hash = b.cost' as column_pairs, 'db.join.c, t' as left_physical_sources, 's.ext.k' as right_physical_sources from statements
 union all select query_id, 2, case when query_id % 2 = 0 then '' else 'nested on statistics' end, '', '', '' from statements where query_id % 3 <> 0"""


@query(
    "plan_evidence",
    rf"""{with_("statements", "plans", "steps")}, j as ({_JOINS}), c as (select *, count(*) over (partition by query_id) as joins from j),
 p as (select *, step_no % 2 as seq, lower(plan_node || ' ' || plan_info) as t, regexp_matches(lower(plan_node || ' ' || plan_info), '\b(join|nestloop|nested loop)\b') as jn from (select *, plan_node_id as step_no from plans where query_id % 11 <> 0)),
 q as (select *, bool_or(jn) over (partition by query_id) as any_join from p), cand as (select *, count(*) over (partition by query_id) as n from q where jn or not any_join),
 sc as (select c.query_id, join_no, joins, n, plan_node_id, seq, plan_node, plan_info, case join_no when 1 then contains(t, 'x = 1')::int * 4 + contains(t, 'filter')::int + contains(t, 'hash')::int + contains(t, 'cost')::int + contains(t, 'db')::int + contains(t, 'join')::int + contains(t, 'ext')::int + 2 * (contains(t, 'join')::int + contains(t, 'ext')::int)
   else case when condition = '' then 0 else contains(t, 'nested')::int + contains(t, 'statistics')::int end end as score from c join cand using (query_id)),
 b as (select * from sc qualify row_number() over (partition by query_id, join_no order by score desc, seq, plan_node_id, plan_node, plan_info) = 1),
 d as (select query_id, step_id as plan_node_id, stream_id as seq, array_to_string(list_sort(list_distinct(list(step_name))), ', ') as names, cast(sum(input_rows) as double) as actual_input_rows, cast(sum(spill_remote) as double) as actual_remote_spill_blocks, cast(max(data_skewness) as double) as actual_max_data_skew from steps group by all),
 r as (select c.query_id, c.join_no, case when b.query_id is null then 'No SYS_QUERY_EXPLAIN rows loaded' when score <= 0 and not (b.joins = 1 and b.n = 1) then 'Plan join present; SQL-to-plan match unresolved' when score >= 4 then 'Matched (high)' when score >= 2 then 'Matched (medium)' else 'Matched (single-join inference)' end as plan_match_status, b.plan_node_id, b.seq, plan_node || ' ' || plan_info as txt from c left join b using (query_id, join_no))
 select r.query_id, join_no, plan_match_status, case when st then r.plan_node_id end as plan_node_id, case when st then r.seq end as plan_child_query_sequence, case when st then coalesce(names, '') else '' end as actual_step_names, case when st then coalesce(actual_input_rows, 0) else 0 end as actual_input_rows, case when st then coalesce(actual_remote_spill_blocks, 0) else 0 end as actual_remote_spill_blocks, case when st then coalesce(actual_max_data_skew, 0) else 0 end as actual_max_data_skew,
  case when not st then '' when contains(txt, 'DS_DIST_BOTH') then 'DS_DIST_BOTH' when contains(txt, 'DS_BCAST_INNER') then 'DS_BCAST_INNER' else 'No mapped movement signal' end as actual_movement from (select *, starts_with(plan_match_status, 'Matched') as st from r) r left join d on d.query_id = r.query_id and d.plan_node_id = r.plan_node_id and d.seq = r.seq""",
)
def plan_evidence(spark, sf):
    relation(spark, sf, "statements").createOrReplaceTempView("_evidence_statements")
    joins = spark.sql(_JOINS.replace("from statements", "from _evidence_statements"))
    explain = relation(spark, sf, "plans").where("query_id % 11 <> 0").withColumn("child_query_sequence", F.expr("plan_node_id % 2"))
    steps = relation(spark, sf, "steps").withColumnsRenamed({"step_id": "plan_node_id", "stream_id": "child_query_sequence", "spill_remote": "spilled_block_remote_disk"})
    found = evidence.plan_evidence(joins, explain, steps)
    return found.select("query_id", "join_no", "plan_match_status", "plan_node_id", "plan_child_query_sequence", "actual_step_names", "actual_input_rows", "actual_remote_spill_blocks", "actual_max_data_skew", "actual_movement")


# Every second table is in the repository, in another database too where its number divides by 4; the rest is live only. References have three forms, some name nothing.
_CATALOG = "select source_db as database_name, schema_name, table_name, table_id, size_mb from tables union all select 'db' || cast((table_id + 1) % 3 as varchar(20)), schema_name, table_name, table_id + 1000000000, size_mb from tables where table_id % 4 = 0"
_IDENTITY = "case table_id % 3 when 0 then source_db || '.' || schema_name || '.' || table_name when 1 then upper(schema_name) || '.' || table_name else case when table_id % 5 = 0 then 'no_' else '' end || table_name end"


@query(
    "catalog_repository",
    f"""{with_("tables")}, cat as ({_CATALOG}), ref as (select distinct {_IDENTITY} as identity from tables),
 k as (select lower(database_name) as db, lower(schema_name || '.' || table_name) as st, lower(table_name) as t, table_id % 2 = 0 as kept from cat), r as (select identity, string_split(lower(identity), '.') as p from ref),
 live as (select * from k where kept or t in (select p[-1] from r where not exists (select 1 from k k2 where k2.kept and ((len(p) = 3 and k2.db || '.' || k2.st = lower(identity)) or (len(p) = 2 and k2.st = lower(identity)) or (len(p) = 1 and k2.t = lower(identity)))))),
 m as (select identity, kept, db || '.' || st as key, db from r join live on (len(p) = 3 and db || '.' || st = lower(identity)) or (len(p) = 2 and st = lower(identity)) or (len(p) = 1 and t = lower(identity))),
 f as (select identity, case when count(*) filter (db = 'db0') = 1 then min(key) filter (db = 'db0') when count(*) = 1 then min(key) end as table_key, bool_and(kept) as kept from m group by 1)
 select identity, table_key, case when table_key is not null then case when kept then 'repository' else 'live' end end as origin from ref left join f using (identity)""",
)
def catalog_repository(spark, sf):
    t = relation(spark, sf, "tables")
    copies = t.where("table_id % 4 = 0").withColumns({"source_db": F.expr("'db' || cast((table_id + 1) % 3 as string)"), "table_id": F.expr("table_id + 1000000000")})
    cat = t.unionByName(copies).select(F.col("source_db").alias("database_name"), "schema_name", "table_name", "table_id", "size_mb")
    columns = cat.select("database_name", "schema_name", "table_name", F.lit("id").alias("column_name"), F.lit("bigint").alias("data_type"), F.lit(1).alias("sortkey_pos"))
    repo = repository.Repository(storage.Store(spark, repository.scratch(spark, "catalog")))
    kept = cat.where("table_id % 2 = 0")
    repo.build(kept, columns.join(kept.select("database_name", "schema_name", "table_name"), ["database_name", "schema_name", "table_name"], "left_semi"))

    def live(names):
        plain = cat.withColumn("table_name", repository.plain("table_name"))
        return repository.for_names(plain, "table_name", names), repository.for_names(columns.withColumn("table_name", repository.plain("table_name")), "table_name", names)

    refs = t.select(F.expr(_IDENTITY.replace("varchar(20)", "string")).alias("identity")).distinct()
    return repo.fetch(refs, live, "db0").select("identity", "table_key", "origin")


@query(
    "statement_enrichment",
    f"{with_('statements')}, k as (select distinct sha256(sql_text) as sql_hash, query_id % 2 as half from statements), n as (select sql_hash, min(half) as half from k group by 1) select sql_hash, count(*) as queries, case when min(n.half) = 0 then 'known' else 'new' end as origin from (select sha256(sql_text) as sql_hash from statements) s join n using (sql_hash) group by 1",
)
def statement_enrichment(spark, sf):
    """All statements enriched in two runs: the first has those of even queries, the second finds them known."""
    store, s = storage.Store(spark, repository.scratch(spark, "features")), relation(spark, sf, "statements")
    enrichment.enriched(s.where("query_id % 2 = 0"), store, 20_000)
    before = store.read(enrichment.CACHE).select("sql_hash", F.lit("known").alias("origin"))
    found, _ = enrichment.enriched(s, store, 20_000)
    per = found.groupBy("sql_hash").agg(F.count("*").alias("queries"))
    return per.join(before, "sql_hash", "left").select("sql_hash", "queries", F.coalesce("origin", F.lit("new")).alias("origin"))
