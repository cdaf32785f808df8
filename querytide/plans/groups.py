"""Queries over repeat patterns and statement shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs, shapes
from ..operators import grouping
from ..sources.adapter import relation, with_
from . import core
from .core import _r, duration_sql, near, near_sql, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def stated(spark, sf: str) -> DataFrame:
    """Statements with who ran them, how long, and a risk."""
    h = relation(spark, sf, "history").select("query_id", "user_name", "database_name", "query_type", exprs.duration_seconds("elapsed_time").alias("elapsed_s"), (F.col("queue_time") / 1e6).alias("risk_score"))
    return relation(spark, sf, "statements").join(h, "query_id")


STATED = f"stated as (select s.query_id, sql_text, user_name, database_name, query_type, {duration_sql('elapsed_time')} as elapsed_s, queue_time / 1e6 as risk_score from statements s join history using (query_id))"


def _rx(c: str, *steps: tuple[str, str]) -> str:
    for p, n in steps:
        c = f"regexp_replace({c}, '{p}', '{n}', 'g')"
    return c


_NOCOMMENT = ((r"(?s)/\*.*?\*/", " "), (r"--[^\n]*", " "))
_STRIP = r"regexp_replace({c}, '(?s)^(?:\s+|--[^\n]*(?:\n|$)|/\*.*?(?:\*/|$))+', '')"
_INNER = r"regexp_extract({c}, '(?is)^unload\s*\(\s*''((?:[^'']|'''')*)''', 1)"


def shape_sql(c: str) -> str:
    """The oracle's shape; RE2 has no look-behind, so numbers take their left neighbour along."""
    t = _rx(c, *_NOCOMMENT, (r"(?s)''(?:[^'']|'''')*''", "?"))
    t = f"lower({t})"
    t = _rx(t, (r"\b([a-z_][a-z0-9_$]*?)_\d{3,}\b", r"\1_#"), (r"(^|[^a-z0-9_$#])\d+(?:\.\d+)?(?:e[+-]?\d+)?\b", r"\1?"), (r"(^|[^a-z0-9_$#])\d+(?:\.\d+)?(?:e[+-]?\d+)?\b", r"\1?"), (r"\(\s*\?(?:\s*,\s*\?)+\s*\)", "(?)"), (r"\s+", " "))
    return f"trim({t})"


_BODY = f"case when {_INNER.format(c=_STRIP.format(c='sql_text'))} <> '' then replace({_INNER.format(c=_STRIP.format(c='sql_text'))}, '''''', '''') else {_STRIP.format(c='sql_text')} end"
_CALLED = rf"regexp_extract(lower({_STRIP.format(c='sql_text')}), '^call\s+([a-z0-9_$.]+)\s*\(', 1)"
CAND = f"""bodies as (select *, {_BODY} as body, {_CALLED} as called from stated),
cand as (select *, case when called <> '' then lower(database_name) || '.' || called end as call_key, case when called <> '' then 'proc' else 'sql' end as kind, (case when regexp_matches({_STRIP.format(c="sql_text")}, '(?i)^unload') then 'unload: ' else '' end) || {shape_sql("body")} as shape from bodies),
ck as (select *, kind || '|all|' || lower(query_type) || '|' || case when kind = 'proc' then call_key else left(sha1(shape), 20) end as constraint_key from cand where length(trim(sql_text)) >= case when kind = 'proc' then 1 else 24 end)"""
_W = f"{with_('history', 'statements')}, {STATED}, {CAND}"


@query("statement_shapes", f"{with_('statements')} select query_id, {shape_sql('sql_text')} as shape from statements")
def statement_shapes(spark, sf):
    return relation(spark, sf, "statements").select("query_id", shapes.regex_shape("sql_text").alias("shape"))


@query("simple_shapes", rf"{with_('statements')} select query_id, lower(trim({_rx('sql_text', *_NOCOMMENT, (r'''(?:[^'']|'''')*''', '?'), (chr(92) + 'b' + chr(92) + 'd+(?:' + chr(92) + '.' + chr(92) + 'd+)?' + chr(92) + 'b', '?'), (chr(92) + 's+', ' '))})) as shape from statements")
def simple_shapes(spark, sf):
    return relation(spark, sf, "statements").select("query_id", shapes.simple_shape("sql_text").alias("shape"))


_KEYED = r"trim(regexp_replace(lower(regexp_replace(regexp_replace(sql_text, '\\r\\n|\\n|\\r', chr(10), 'g'), '\\t', chr(9), 'g')), '\s+', ' ', 'g'))"


@query(
    "repeating_queries",
    rf"""{with_("history", "statements")}, {STATED}, n as (select *, trim(regexp_replace(lower(sql_text), '\s+', ' ', 'g')) as norm from stated), c as (select query_id, count(*) over (partition by norm) as text_runs, case when trim(user_name) <> '' then count(*) over (partition by lower(trim(user_name)), left(norm, 64), right(norm, 64)) else 0 end as affix_runs from n where norm <> '')
 select query_id, text_runs, affix_runs from c where text_runs >= 3 or affix_runs >= 3""",
)
def repeating_queries(spark, sf):
    return grouping.repeating(stated(spark, sf)).select("query_id", "text_runs", "affix_runs")


@query(
    "repeating_by_hash",
    rf"""{with_("history", "statements")}, {STATED}, n as (select *, trim(regexp_replace(lower(sql_text), '\s+', ' ', 'g')) as norm, case when query_id % 4 = 0 then 'h' || cast(query_id // 16 as varchar) else '' end as query_hash from stated), c as (select query_id, query_hash, count(*) over (partition by norm) as text_runs, case when trim(user_name) <> '' then count(*) over (partition by lower(trim(user_name)), left(norm, 64), right(norm, 64)) else 0 end as affix_runs, case when query_hash <> '' then count(*) over (partition by query_hash) else 0 end as hash_runs from n where norm <> '')
 select query_id, text_runs, affix_runs, hash_runs from c where text_runs >= 3 or affix_runs >= 3 or hash_runs >= 3""",
)
def repeating_by_hash(spark, sf):
    q = stated(spark, sf).withColumn("query_hash", F.expr("case when query_id % 4 = 0 then 'h' || cast(query_id div 16 as string) else '' end"))
    return grouping.repeating(q).select("query_id", "text_runs", "affix_runs", "hash_runs")


@query("group_candidates", f"{_W} select query_id, kind, call_key, constraint_key from ck")
def group_candidates(spark, sf):
    return grouping.candidates(stated(spark, sf)).select("query_id", "kind", "call_key", "constraint_key")


_GROUPS = """gr as (select constraint_key, count(*) as query_count, sum(elapsed_s) as total_runtime_s, avg(elapsed_s) as avg_runtime_s, max(elapsed_s) as max_runtime_s, max(risk_score) as max_risk, first(query_id order by risk_score desc, elapsed_s desc, query_id) as representative_id,
 first(shape order by risk_score desc, elapsed_s desc, query_id) as shape, first(kind order by risk_score desc, elapsed_s desc, query_id) as repeat_kind, min(query_id) as first_id, max(query_id) as last_id, count(distinct user_name) as user_count from ck group by constraint_key having count(*) >= 2)"""
_KEY = "'G' || left(sha256(repeat_kind || '|' || constraint_key || '|' || shape), 12) as repeat_group_key"
_G = ["total_runtime_s", "avg_runtime_s", "max_runtime_s"]


@query("repeat_groups", f"{_W}, {_GROUPS} select query_count, {_r(*_G, digits=3)}, max_risk, representative_id, repeat_kind, first_id, last_id, user_count, {_KEY} from gr")
def repeat_groups(spark, sf):
    found = grouping.groups(grouping.candidates(stated(spark, sf)))
    return rounded(found, *_G, digits=3).select("query_count", *_G, "max_risk", "representative_id", "repeat_kind", "first_id", "last_id", "user_count", "repeat_group_key")


@query("repeat_group_ranking", f"{_W}, {_GROUPS}, k as (select {_KEY}, {near_sql('total_runtime_s', 3)} as total_runtime_s, max_risk, query_count from gr) select *, row_number() over (order by total_runtime_s desc, max_risk desc, query_count desc, repeat_group_key) as group_rank, 'RQ' || case when row_number() over (order by total_runtime_s desc, max_risk desc, query_count desc, repeat_group_key) < 1000 then lpad(cast(row_number() over (order by total_runtime_s desc, max_risk desc, query_count desc, repeat_group_key) as varchar), 3, '0') else cast(row_number() over (order by total_runtime_s desc, max_risk desc, query_count desc, repeat_group_key) as varchar) end as repeat_group_id from k")
def repeat_group_ranking(spark, sf):
    found = rounded(grouping.groups(grouping.candidates(stated(spark, sf))), "total_runtime_s", digits=3)
    return grouping.display_ranked(found).select("repeat_group_key", "total_runtime_s", "max_risk", "query_count", "group_rank", "repeat_group_id")


@query("repeat_members", f"{_W}, {_GROUPS} select query_id, {_KEY.replace('shape', 'gr.shape').replace('constraint_key', 'gr.constraint_key')}, row_number() over (partition by ck.constraint_key order by elapsed_s desc, risk_score desc, query_id) as member_rank, row_number() over (partition by ck.constraint_key order by elapsed_s desc, risk_score desc, query_id) <= 10 as shown_in_tree from ck join gr using (constraint_key)")
def repeat_members(spark, sf):
    found = grouping.candidates(stated(spark, sf))
    return grouping.members(found, grouping.groups(found)).select("query_id", "repeat_group_key", "member_rank", "shown_in_tree")


@query("group_diagnostics", f"{_W}, b as (select kind, constraint_key, count(*) as n from ck group by all) select kind, count(*) as buckets, cast(sum(n) as bigint) as statements, count(*) filter (n > 1) as repeat_buckets, cast(sum(n * (n - 1) // 2) as bigint) as pairs, max(n) as largest from b group by kind")
def group_diagnostics(spark, sf):
    return grouping.diagnostics(grouping.candidates(stated(spark, sf)))


_SIMPLE = f"md5(lower(trim({_rx('sql_text', *_NOCOMMENT, (chr(39) * 2 + '(?:[^' + chr(39) * 2 + ']|' + chr(39) * 4 + ')*' + chr(39) * 2, '?'), (chr(92) + 'b' + chr(92) + 'd+(?:' + chr(92) + '.' + chr(92) + 'd+)?' + chr(92) + 'b', '?'), (chr(92) + 's+', ' '))})))"
ORACLES["simple_shapes"] = f"{with_('statements')} select query_id, {_SIMPLE[4:-1]} as shape from statements"


@query("parent_targets", f"{with_('history', 'statements')}, {STATED} select fingerprint, {near_sql('total_s', 3)} as total_s, runs, target_id from (select {_SIMPLE} as fingerprint, sum(elapsed_s) as total_s, count(*) as runs, first(query_id order by elapsed_s desc, query_id) as target_id from stated group by 1 order by total_s desc, fingerprint limit 500)")
def parent_targets(spark, sf):
    return rounded(grouping.parent_targets(stated(spark, sf)), "total_s", digits=3)


@query("repeated_ids", rf"{with_('history', 'statements')}, {STATED}, o as (select *, lower(case when trim(user_name) in ('', 'None', 'NULL') then '' else trim(user_name) end) as owner, left(trim(regexp_replace(lower(sql_text), '\s+', ' ', 'g')), 80) as head from stated), k as (select * from o where head <> '' qualify count(*) over (partition by owner, head) > 1) select owner, {_SIMPLE} as fingerprint, count(*) as runs, first(query_id order by elapsed_s desc, query_id) as query_id from k group by all")
def repeated_ids(spark, sf):
    return grouping.repeated_ids(stated(spark, sf))


@query("evidence_targets", f"{with_('history', 'statements', 'steps')} select query_id, database_name, md5(sql_text) as text_md5 from history join statements using (query_id) where status = 'success' and not result_cache_hit and query_type not in ('PROCEDURE', 'UTILITY') and query_id in (select query_id from steps) qualify row_number() over (partition by database_name, md5(sql_text) order by execution_time desc nulls last, elapsed_time desc nulls last, query_id) = 1")
def evidence_targets(spark, sf):
    return grouping.evidence_targets(relation(spark, sf, "history"), relation(spark, sf, "steps"), relation(spark, sf, "statements")).select("query_id", "database_name", "text_md5")


_TABLE = r"list_distinct(regexp_extract_all(shape, '\b(?:from|join|update|into)\s+([a-z_#][a-z0-9_$#]*(?:\s*\.\s*[a-z_][a-z0-9_$#]*){0,2})', 1))"


@query("statement_features", f"{_W} select query_id, array_to_string(list_sort({_TABLE}), ', ') as sql_tables, cast(len({_TABLE}) as bigint) as table_count, cast(len(regexp_extract_all(shape, '\\bjoin\\b')) as bigint) as join_count, cast(len(regexp_extract_all(shape, '\\b(?:where|and|or|on|having)\\b')) as bigint) as predicate_count, regexp_matches(shape, 'select\\s+(?:distinct\\s+)?\\*') as has_wildcard from (select query_id, {shape_sql('body')} as shape from cand)")
def statement_features(spark, sf):
    return grouping.features(relation(spark, sf, "statements")).select("query_id", "sql_tables", "table_count", "join_count", "predicate_count", "has_wildcard")


@query("fuzzy_groups")
def fuzzy_groups(spark, sf):
    return grouping.fuzzy_merged(grouping.candidates(stated(spark, sf)))


@query("similar_statements")
def similar_statements(spark, sf):
    return grouping.similar_to("select a, b from brand_1.part_x_1 where name like '%x'", relation(spark, sf, "statements")).select("query_id", near("similarity").alias("similarity"))


# two statements over each nation's own table, which no other statement shares
_LONE = "select 2000000000 + 2 * n_nationkey + i as query_id, case i when 0 then 'select a, b from lone_' || lower(replace(n_name, ' ', '_')) || ' where v > 1' else 'select b from lone_' || lower(replace(n_name, ' ', '_')) || ' order by b desc limit 5' end as sql_text, 'u' as user_name, 'db0' as database_name, 'SELECT' as query_type, cast(n_nationkey + i as double) as elapsed_s, cast(i as double) as risk_score from {nation} cross join (select 0 as i union all select 1) two"
_LONELY = f"{with_('history', 'statements')}, {STATED}, every as (select query_id, sql_text, user_name, database_name, query_type, elapsed_s, risk_score from stated union all {_LONE.replace('{nation}', 'nation')}), {CAND.replace('from stated)', 'from every)')}"


@query("missed_groups", f"{_LONELY}, {_GROUPS}, rest as (select *, array_to_string(list_sort({_TABLE}), ',') as table_set from ck where constraint_key not in (select constraint_key from gr)) select query_type, table_set, count(*) as statements, count(distinct shape) as distinct_shapes, {near_sql('sum(elapsed_s)', 3)} as runtime_s from rest where table_set <> '' group by query_type, table_set having count(*) >= 2 and count(distinct shape) >= 2 order by sum(elapsed_s) desc, query_type, table_set limit 40")
def missed_groups(spark, sf):
    lone = spark.sql(_LONE.replace("{nation}", f"parquet.`{sf}/nation.parquet`"))
    found = grouping.candidates(stated(spark, sf).select(*lone.columns).unionByName(lone))
    return rounded(grouping.missed(found, grouping.groups(found)), "runtime_s", digits=3)


_TOTALS = ["elapsed_s", "input_rows", "output_rows", "input_bytes", "total_spill", "duration", "alert_count", "external_duration"]
_MEANS = ["elapsed_s", "queue_s", "risk_score", "step_cnt", "segment_cnt", "stream_cnt", "table_cnt", "input_rows", "output_rows", "input_bytes", "total_spill", "local_spill", "remote_spill", "max_data_skewness", "max_time_skewness", "remote_io_ratio", "selectivity_ratio", "external_duration_pct", "external_steps", "s3_steps", "join_steps", "agg_steps", "sort_steps", "scan_steps", "alert_count", "seq_scan_cnt", "dist_both_cnt", "bcast_cnt", "dist_total_cnt", "has_nested_loop", "network_cnt", "cost_score"]


def measured(spark, sf) -> DataFrame:
    """Candidates with everything measured of their queries."""
    s = core.slow(spark, sf).where("sql_text is not null")
    return grouping.candidates(s)


_MEASURED = f"{with_(*core.BASE)}, {core.SLOW}, stated as (select * from slow where sql_text is not null), {CAND}"


@query("repeat_report", f"""{_MEASURED}, g as (select constraint_key as group_key, count(*) as query_count, {', '.join(f"sum(coalesce({c}, 0)) as total_{c}" for c in _TOTALS)}, {', '.join(f"avg({c}) as avg_{c}" for c in _MEANS)}, min(query_id) as representative_id, first(shape order by query_id) as shape, first(kind order by query_id) as repeat_kind, count(distinct user_name) as user_count, md5(array_to_string(list_sort(list(distinct query_id)), ',')) as ids_md5 from ck group by 1 having count(*) >= 2)
 select query_count, representative_id, repeat_kind, user_count, ids_md5, array_to_string(list_sort({_TABLE}), ', ') as all_tables, array_to_string(list_sort({_TABLE}), ', ') as common_tables, 'G' || left(sha256(repeat_kind || '|' || group_key || '|' || shape), 12) as repeat_group_key, {', '.join(f"{near_sql(f'total_{c}', 1)} as total_{c}" for c in _TOTALS)}, {', '.join(f"{near_sql(f'avg_{c}', 2)} as avg_{c}" for c in _MEANS)} from g""")
def repeat_report(spark, sf):
    found = grouping.report(measured(spark, sf), _TOTALS, _MEANS)
    t, m = [f"total_{c}" for c in _TOTALS], [f"avg_{c}" for c in _MEANS]
    out = rounded(rounded(found, *t, digits=1), *m, digits=2).withColumn("ids_md5", F.md5(F.array_join(F.transform("query_ids", lambda x: x.cast("string")), ",")))
    return out.select("query_count", "representative_id", "repeat_kind", "user_count", "ids_md5", "all_tables", "common_tables", "repeat_group_key", *t, *m)


@query("repeat_report_merged")
def repeat_report_merged(spark, sf):
    """The report with near-equal shapes merged; their clusters are beyond SQL, pytest holds them against brute force."""
    found = measured(spark, sf)
    return grouping.report(found, _TOTALS, _MEANS, grouping.fuzzy_merged(found))
