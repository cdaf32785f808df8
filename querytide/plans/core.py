"""Queries over rollups, slow queries, rules, table impact and actions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import gold, rollups, rules
from ..sources import storage
from ..sources.adapter import relation, with_

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def near(c: str, digits: int = 5) -> Column:
    """Rounded half up in plain double arithmetic, nudged past ties, so that both engines agree on every value."""
    return F.floor(F.col(c).cast("double") * 10**digits + F.lit(0.500001)) / F.lit(float(10**digits))


def rounded(df: DataFrame, *columns: str, digits: int = 5) -> DataFrame:
    return df.withColumns({c: near(c, digits) for c in columns})


def near_sql(c: str, digits: int = 5) -> str:
    return f"floor(cast({c} as double) * {10**digits} + 0.500001) / {float(10**digits)}"


def _r(*columns: str, digits: int = 5) -> str:
    return ", ".join(f"{near_sql(c, digits)} as {c}" for c in columns)



# The oracle's building blocks ------------------------------------------------------------------
SR = """sr as (select query_id, count(*) as step_cnt, count(distinct segment_id) as segment_cnt, count(distinct stream_id) as stream_cnt, count(distinct table_id) as table_cnt,
 cast(sum(input_rows) as bigint) as input_rows, cast(sum(output_rows) as bigint) as output_rows, cast(sum(input_bytes) as bigint) as input_bytes, cast(sum(spill_local) as bigint) as local_spill, cast(sum(spill_remote) as bigint) as remote_spill,
 max(data_skewness) as max_data_skewness, max(time_skewness) as max_time_skewness, cast(sum(local_read_io) as bigint) as local_read_io, cast(sum(remote_read_io) as bigint) as remote_read_io, cast(sum(duration) as bigint) as duration,
 cast(coalesce(sum(duration) filter (source = 's3'), 0) as bigint) as external_duration, count(*) filter (source in ('s3', 'external', 'spectrum')) as external_steps, count(*) filter (source = 's3') as s3_steps, count(*) filter (step_name like '%join%') as join_steps, count(*) filter (step_name like '%aggregate%') as agg_steps,
 count(*) filter (step_name like '%sort%') as sort_steps, count(*) filter (step_name like '%scan%') as scan_steps, count(alert) as alert_count,
 cast(coalesce(sum(input_rows) filter (source = 's3'), 0) as bigint) as ext_input_rows, cast(coalesce(sum(output_rows) filter (source = 's3'), 0) as bigint) as ext_output_rows, cast(coalesce(sum(spill_remote) filter (source = 's3'), 0) as bigint) as external_spill_blocks
 from steps group by query_id),
st as (select *, local_spill + remote_spill as total_spill, case when remote_read_io + local_read_io > 0 then remote_read_io / cast(remote_read_io + local_read_io as double) end as remote_io_ratio,
 case when duration > 0 then external_duration / cast(duration as double) end as external_duration_pct, case when input_rows > 0 then output_rows / cast(input_rows as double) end as selectivity_ratio,
 case when ext_input_rows > 0 then ext_output_rows / cast(ext_input_rows as double) end as ext_selectivity from sr)"""


def _pc(text: str) -> str:
    return ", ".join(f"max(case when contains({text}, '{word}') then 1 else 0 end)::bigint as {k}" if k in rollups.PLAN_FLAGS else f"count(*) filter (contains({text}, '{word}')) as {k}" for k, word in rollups.PLAN_COUNTS.items())


_ISSUE = "case when dist_both_cnt > 0 then 'BAD_DISTRIBUTION' when has_nested_loop > 0 then 'NESTED_LOOP_RISK' when s3_scan_cnt > 0 then 'S3_HEAVY' when missing_stats_flag > 0 then 'MISSING_STATS' when seq_scan_cnt > 5 then 'SCAN_HEAVY' {f} else 'GENERAL' end as dominant_issue"
_MAX = r"max(try_cast(regexp_extract(lower(plan_node), 'rows=(\d+)', 1) as bigint)) as max_plan_rows, max(try_cast(regexp_extract(lower(plan_node), 'cost=[0-9.]*?\.\.([0-9]+)', 1) as bigint)) as max_plan_cost"
PL = f"""pc as (select query_id, count(*) as node_cnt, {_pc("lower(plan_node || ' ' || plan_info)")}, {_MAX} from plans group by query_id),
pl as (select *, seq_scan_cnt + 3*s3_scan_cnt + 5*dist_both_cnt + 2*bcast_cnt + 10*has_nested_loop + 8*missing_stats_flag + 2*partition_loop_cnt + filter_node_cnt + sort_node_cnt as cost_score,
 {_ISSUE.format(f="when filter_node_cnt > 3 then 'FILTER_HEAVY'")},
 case when dist_both_cnt*5 + has_nested_loop*10 + filter_node_cnt + sort_node_cnt > 50 then 'VERY_EXPENSIVE' when seq_scan_cnt + 3*s3_scan_cnt > 20 then 'EXPENSIVE' when seq_scan_cnt + s3_scan_cnt > 10 then 'MODERATE' else 'LIGHT' end as cost_tier from pc)"""
PR = f"""pc as (select query_id, count(*) as node_cnt, {_pc("lower(plan_node)")}, {_MAX} from plans group by query_id),
pr as (select *, seq_scan_cnt + 3*s3_scan_cnt + 5*dist_both_cnt + 2*bcast_cnt + 10*has_nested_loop + 8*missing_stats_flag + 2*partition_loop_cnt as cost_score, {_ISSUE.format(f="")},
 case when dist_both_cnt*5 + has_nested_loop*10 > 50 then 'VERY_EXPENSIVE' when seq_scan_cnt + 3*s3_scan_cnt > 20 then 'EXPENSIVE' when seq_scan_cnt + s3_scan_cnt > 10 then 'MODERATE' else 'LIGHT' end as cost_tier from pc)"""
_DUR = "case when abs({v}) / 1e6 <= 31536000 then {v} / 1e6 when abs({v}) / 1e9 <= 31536000 then {v} / 1e9 when abs({v}) / 1e3 <= 31536000 then {v} / 1e3 when abs({v}) <= 31536000 then {v} end"


def duration_sql(v: str) -> str:
    return _DUR.format(v=f"cast({v} as double)")


HI = f"""hi as (select query_id, user_id, database_name, user_name, query_type, status, namespace_id, coalesce(case when epoch_us(end_time) >= epoch_us(start_time) and (epoch_us(end_time)//1000 - epoch_us(start_time)//1000) / 1000.0 <= 31536000 then (epoch_us(end_time)//1000 - epoch_us(start_time)//1000) / 1000.0 end, {duration_sql("elapsed_time")}) as elapsed_hist, {duration_sql("queue_time")} as queue_s from history)"""
SLOW = f"""{SR}, {PL}, {HI},
sp as (select query_id from history union select query_id from st union select query_id from pl union select query_id from statements),
sj as (select sp.query_id, hi.* exclude (query_id), st.* exclude (query_id), pl.* exclude (query_id), statements.sql_text from sp left join hi using (query_id) left join st using (query_id) left join pl using (query_id) left join statements using (query_id)),
slow as (select * exclude (elapsed_hist), coalesce(elapsed_hist, {duration_sql("duration")}) as elapsed_s,
 coalesce(cost_score, 0) + coalesce(total_spill, 0) / 1e4 + coalesce(remote_io_ratio, 0) * 20 + coalesce(max_data_skewness, 0) * 2 + coalesce(max_time_skewness, 0) * 2 + coalesce(external_duration_pct, 0) * 10
 + case when coalesce(has_nested_loop, 0) > 0 then 15 else 0 end + case when coalesce(dist_both_cnt, 0) > 0 then 12 else 0 end as risk_score from sj)"""
BASE = ("history", "steps", "plans", "statements", "tables")
_MISSING = "regexp_replace(upper(trim(coalesce(sortkey1, ''))), '\\s+', '', 'g') in (" + ", ".join(f"'{x}'" for x in exprs.MISSING_SORTKEY_SQL) + ")"
RISK = f"""risk as (select *, lower(source_db || '.' || schema_name || '.' || table_name) as table_key,
 case when skew_rows >= 3 then least(8*skew_rows, 40) else 0 end + case when unsorted_pct >= 20 then least(unsorted_pct/2, 30) else 0 end + case when stats_off >= 10 then least(stats_off/2, 30) else 0 end
 + case when vacuum_sort_benefit >= 10 then least(vacuum_sort_benefit, 20) else 0 end + case when upper(diststyle) like 'ALL%' and size_mb >= 1024 then 25 else 0 end + case when {_MISSING} and size_mb >= 1024 then 20 else 0 end as table_risk_score from tables)"""
_NUMBERS = ["step_cnt", "input_rows", "output_rows", "input_bytes", "total_spill", "external_spill_blocks", "remote_io_ratio", "max_data_skewness", "max_time_skewness", "bcast_cnt", "dist_both_cnt", "dist_total_cnt", "has_nested_loop", "missing_stats_flag", "s3_scan_cnt", "s3_steps", "external_duration_pct", "ext_input_rows", "seq_scan_cnt", "partition_loop_cnt", "network_cnt", "cost_score", "alert_count", "selectivity_ratio", "agg_steps", "join_steps", "sort_steps", "queue_s"]
QOP = "qo as (select query_id, selectivity_ratio as selectivity_ratio_raw, ext_selectivity as ext_selectivity_raw, coalesce(sql_text, '') as sql_text, " + ", ".join(f"coalesce({c}, 0) as {c}" for c in _NUMBERS) + " from slow)"


def _duck(sql: str) -> str:
    sql = re.sub(r"(lower\((?:[^()]|\([^()]*\))*\)) rlike ('(?:[^']|'')*')", lambda m: f"regexp_matches({m[1]}, {m[2]})", sql)
    return sql.replace("\\\\", "\\")


def union_of(catalogue: list[rules.Rule], source: str, scope: str, subject: str) -> str:
    """The catalogue as the oracle states it: one branch per rule."""
    return " union all ".join(
        f"select '{scope}' as scope, cast({subject} as varchar) as subject, '{r.name}' as rule_id, case when {_duck(r.critical)} then 'crit' else '{r.otherwise}' end as severity, cast({_duck(r.metric)} as double) as metric_value, cast({_duck(r.impact)} as double) as impact_score from {source} where {_duck(r.when)}"
        for r in catalogue
    )


TOP = f"top as (select *, {_MISSING} as no_sortkey from risk)"
INSIGHTS = f"ins as ({union_of(rules.QUERY_RULES, 'qo', 'query', 'query_id')} union all {union_of(rules.TABLE_RULES, 'top', 'table', 'table_id')})"
REWRITES = f"rew as ({union_of(rules.REWRITE_RULES, 'qo', 'query', 'query_id')} union all {union_of([rules.TABLE_REWRITE], 'top', 'table', 'table_id')})"
REFS = r"""said as (select distinct query_id, unnest(regexp_extract_all(lower(sql_text), '[a-z_][a-z0-9_$]*(?:\.[a-z_][a-z0-9_$]*){0,2}')) as mention from slow where sql_text is not null),
refs as (select query_id, table_id, table_risk_score, min(strength) as strength from (
 select query_id, table_id, table_risk_score, case when len(string_split(mention, '.')) = 3 and mention = table_key then 1 when len(string_split(mention, '.')) = 2 and mention = schema_name || '.' || lower(table_name) then 2
  when len(string_split(mention, '.')) = 1 and length(mention) >= 4 then 3 when len(string_split(mention, '.')) = 3 and array_to_string(string_split(mention, '.')[2:3], '.') = schema_name || '.' || lower(table_name) then 2 end as strength
 from said join risk on string_split(mention, '.')[-1] = lower(table_name)) where strength is not null group by all)"""


def _impact(time: str) -> str:
    return f"""imp as (select table_id, max(table_risk_score) as risk, count(*) as slow_query_count, sum(coalesce(elapsed_s, 0)) as total_elapsed_s, avg(coalesce(elapsed_s, 0)) as avg_elapsed_s, max(elapsed_s) as max_elapsed_s, cast(sum(coalesce(total_spill, 0)) as bigint) as total_spill,
 count(*) filter (dist_total_cnt > 0) as redistribution_count, count(*) filter (bcast_cnt > 0) as broadcast_count, count(*) filter (max_data_skewness >= 4) as skewed_count, max(risk_score) as max_query_risk from refs join slow using (query_id) group by table_id),
impact as (select *, risk + least(slow_query_count * 2.5, 35) + least({time} / 3600, 35) + least(total_spill / 1e5, 20) + least(redistribution_count * 3, 25) as blast_radius_score from imp)"""


SCANS = """ps as (select query_id, full_table_name, count(*) as scan_cnt, sum(duration) / 1e6 as duration_s, sum(input_rows) / 1e6 as input_rows_m, count(distinct query_id) filter (is_rrscan) as rr, count(distinct query_id) filter (not is_rrscan) as nrr from scans group by all),
ts as (select lower(full_table_name) as table_key, cast(sum(greatest(rr, nrr)) as bigint) as scan_query_count, sum(duration_s) as scan_duration_s, sum(input_rows_m) as scan_input_rows_m, cast(sum(rr) as bigint) as rrscan_queries, cast(sum(nrr) as bigint) as non_rrscan_queries from ps group by 1),
tsc as (select *, rrscan_queries / cast(scan_query_count as double) as rrscan_query_pct, non_rrscan_queries / cast(scan_query_count as double) as full_scan_query_pct from ts)"""


# Operators over the adapter's relations --------------------------------------------------------
def slow(spark, sf: str) -> DataFrame:
    r = lambda n: relation(spark, sf, n)
    return gold.slow_queries(r("history").drop("execution_time"), rollups.step_rollup(r("steps")), rollups.plan_rollup_local(r("plans")), r("statements"))


def risk(spark, sf: str) -> DataFrame:
    return gold.table_risk(relation(spark, sf, "tables"))


_STEP_RATIOS = ["remote_io_ratio", "external_duration_pct", "selectivity_ratio", "ext_selectivity"]


@query("step_rollup", f"{with_('steps')}, {SR} select * exclude ({', '.join(_STEP_RATIOS)}), {_r(*_STEP_RATIOS)} from st")
def step_rollup(spark, sf):
    return rounded(rollups.step_rollup(relation(spark, sf, "steps")), *_STEP_RATIOS)


@query("plan_rollup_capture", f"{with_('plans')}, {PR} select * from pr")
def plan_rollup_capture(spark, sf):
    return rollups.plan_rollup(relation(spark, sf, "plans"))


@query("plan_rollup_local", f"{with_('plans')}, {PL} select * from pl")
def plan_rollup_local(spark, sf):
    return rollups.plan_rollup_local(relation(spark, sf, "plans"))


@query(
    "step_flow",
    f"""{with_("steps")}, g as (select query_id, stream_id, segment_id, step_id, step_name, table_id, source, cast(sum(input_rows) as bigint) as input_rows, cast(sum(output_rows) as bigint) as output_rows, cast(sum(spill_local) as bigint) as local_spill, cast(sum(spill_remote) as bigint) as remote_spill,
 max(data_skewness) as data_skewness, max(time_skewness) as time_skewness, sum(local_read_io) as lio, sum(remote_read_io) as rio, cast(sum(duration) as bigint) as duration, max(alert) as alert from steps group by all),
 s as (select *, least(remote_spill / 1000, 25) + least(local_spill / 1000, 15) + case when alert is not null then 20 else 0 end + case when data_skewness >= 3 then 15 when data_skewness >= 2 then 8 else 0 end + case when time_skewness >= 3 then 15 when time_skewness >= 2 then 8 else 0 end
 + case when rio > lio then 10 else 0 end + case when source <> 'internal' then 8 else 0 end + case when contains(step_name, 'join') and greatest(input_rows, output_rows) >= 10000000 then 8 else 0 end + case when contains(step_name, 'scan') and greatest(input_rows, output_rows) >= 10000000 then 6 else 0 end as pain_score,
 case when alert is not null then 'ALERT' when remote_spill > 0 then 'REMOTE_SPILL' when local_spill > 0 then 'LOCAL_SPILL' when data_skewness >= 2 then 'DATA_SKEW' when time_skewness >= 2 then 'TIME_SKEW' when rio > lio then 'REMOTE_IO' when source <> 'internal' then 'EXTERNAL_SOURCE'
 when contains(step_name, 'join') and greatest(input_rows, output_rows) >= 10000000 then 'LARGE_JOIN' when contains(step_name, 'scan') and greatest(input_rows, output_rows) >= 10000000 then 'LARGE_SCAN' else 'NORMAL' end as dominant_pain from g)
 select query_id, step_id, table_id, duration, {near_sql('pain_score')} as pain_score, dominant_pain, row_number() over (partition by query_id order by stream_id, segment_id, step_id, table_id nulls last, source nulls last, step_name nulls last) as execution_rank,
 row_number() over (partition by query_id order by pain_score desc, duration desc, stream_id, segment_id, step_id, table_id nulls last, source nulls last, step_name nulls last) as pain_rank from s""",
)
def step_flow(spark, sf):
    return rounded(rollups.step_flow(relation(spark, sf, "steps")).select("query_id", "step_id", "table_id", "duration", "pain_score", "dominant_pain", "execution_rank", "pain_rank"), "pain_score")


@query("scan_rollup", f"{with_('scans')}, {SCANS} select query_id, lower(full_table_name) as table_key, scan_cnt, {_r('duration_s', 'input_rows_m')}, rr as rrscan_queries, nrr as non_rrscan_queries from ps")
def scan_rollup(spark, sf):
    found = rollups.scan_rollup(relation(spark, sf, "scans"))
    return rounded(found.select("query_id", F.concat_ws(".", "table_database", "schema_name", "table_name").alias("table_key"), "scan_cnt", "duration_s", "input_rows_m", "rrscan_queries", "non_rrscan_queries"), "duration_s", "input_rows_m")


@query("table_scans", f"{with_('scans')}, {SCANS} select * exclude (scan_duration_s, scan_input_rows_m, rrscan_query_pct, full_scan_query_pct), {_r('scan_duration_s', 'scan_input_rows_m', 'rrscan_query_pct', 'full_scan_query_pct')} from tsc")
def table_scans(spark, sf):
    found = rollups.table_scans(relation(spark, sf, "scans")).withColumn("table_key", F.concat_ws(".", "table_database", "schema_name", "table_name")).drop("table_database", "schema_name", "table_name")
    return rounded(found, "scan_duration_s", "scan_input_rows_m", "rrscan_query_pct", "full_scan_query_pct")


@query("text_assembly", f"{with_('fragments')} select query_id, md5(string_agg(text, '' order by sequence nulls last, text)) as text_md5, count(*) as fragment_cnt from fragments where text is not null group by query_id")
def text_assembly(spark, sf):
    return rollups.assembled(relation(spark, sf, "fragments"), "query_id").select("query_id", F.md5("sql_text").alias("text_md5"), "fragment_cnt")


@query("user_lookup", f"{with_('users')} select namespace_id, user_id, max(user_name) as user_name from users group by all")
def user_lookup(spark, sf):
    return rollups.known_users(relation(spark, sf, "users"))


@query(
    "history_with_users",
    f"""{with_("history", "users")}, u as (select namespace_id, user_id, max(user_name) as looked from users group by all) select query_id, coalesce(case when user_name <> '' and not regexp_full_match(user_name, '[0-9]+') then user_name end, looked, cast(h.user_id as varchar)) as user_label,
 round({duration_sql("elapsed_time")}, 6) as elapsed_s from history h left join u on u.namespace_id = h.namespace_id and u.user_id = h.user_id""",
)
def history_with_users(spark, sf):
    u = rollups.known_users(relation(spark, sf, "users")).withColumnsRenamed({"user_name": "looked", "namespace_id": "u_ns", "user_id": "u_id"})
    h = relation(spark, sf, "history")
    joined = h.join(u, h["namespace_id"].eqNullSafe(u["u_ns"]) & (h["user_id"] == u["u_id"]), "left")
    return joined.select("query_id", exprs.user_label("user_name", "looked", "user_id").alias("user_label"), F.round(exprs.duration_seconds("elapsed_time"), 6).alias("elapsed_s"))


@query("history_union", f"{with_('history', 'history_all')} select namespace_id, origin, count(*) as n, cast(sum(elapsed_time) as bigint) as elapsed_time, min(query_id) as first_id from (select query_id, namespace_id, elapsed_time, 'primary' as origin from history where query_id % 3 <> 0 union all select query_id, namespace_id, elapsed_time, origin from history_all a where not exists (select 1 from history h where query_id % 3 <> 0 and h.query_id = a.query_id and h.namespace_id is not distinct from a.namespace_id)) group by all")
def history_union(spark, sf):
    primary = relation(spark, sf, "history").where("query_id % 3 <> 0").select("query_id", "namespace_id", "elapsed_time", F.lit("primary").alias("origin"))
    both = gold.union_history(primary, relation(spark, sf, "history_all"))
    return both.groupBy("namespace_id", "origin").agg(F.count("*").alias("n"), F.sum("elapsed_time").alias("elapsed_time"), F.min("query_id").alias("first_id"))


_HEALTH = ["node_cnt", "seq_scan_cnt", "dist_total_cnt", "cost_score", "dominant_issue", "cost_tier"]


@query("health_merge", f"{with_('plans')}, {PL}, cap as (select * from pl where query_id % 2 = 0), der as (select * from pl where query_id % 3 = 0) select coalesce(cap.query_id, der.query_id) as query_id, {', '.join(f'coalesce(cap.{c}, der.{c}) as {c}' for c in _HEALTH)} from cap full outer join der on cap.query_id is not distinct from der.query_id")
def health_merge(spark, sf):
    found = rollups.plan_rollup_local(relation(spark, sf, "plans")).select("query_id", *_HEALTH)
    return gold.merged_health(found.where("query_id % 2 = 0"), found.where("query_id % 3 = 0"))


@query("slow_queries", f"{with_(*BASE)}, {SLOW} select query_id, {near_sql('elapsed_s', 4)} as elapsed_s, {near_sql('queue_s', 4)} as queue_s, {near_sql('risk_score')} as risk_score, total_spill, cost_score, sql_text is not null as has_text from slow")
def slow_queries(spark, sf):
    return rounded(slow(spark, sf), "elapsed_s", "queue_s", digits=4).select("query_id", "elapsed_s", "queue_s", near("risk_score").alias("risk_score"), "total_spill", "cost_score", F.col("sql_text").isNotNull().alias("has_text"))


@query("slow_query_ranking", f"{with_(*BASE)}, {SLOW} select query_id, {near_sql('risk_score')} as risk_score, {near_sql('elapsed_s', 4)} as elapsed_s from slow order by 2 desc nulls last, 3 desc nulls last, 1 limit 500")
def slow_query_ranking(spark, sf):
    found = rounded(slow(spark, sf), "risk_score").withColumn("elapsed_s", near("elapsed_s", 4))
    return found.orderBy(F.desc_nulls_last("risk_score"), F.desc_nulls_last("elapsed_s"), "query_id").limit(500).select("query_id", "risk_score", "elapsed_s")


_FOUND = f"scope, subject, rule_id, severity, {near_sql('metric_value')} as metric_value, {near_sql('impact_score')} as impact_score"


def _found(df: DataFrame) -> DataFrame:
    return rounded(df, "metric_value", "impact_score")


@query("insights", f"{with_(*BASE)}, {SLOW}, {RISK}, {QOP}, {TOP}, {INSIGHTS} select {_FOUND} from ins")
def insights(spark, sf):
    return _found(rules.insights(slow(spark, sf), risk(spark, sf)))


@query("insight_families", f"{with_(*BASE)}, {SLOW}, {RISK}, {QOP}, {TOP}, {INSIGHTS} select rule_id, count(*) as findings, count(*) filter (severity = 'crit') as crit_count, count(*) filter (severity = 'warn') as warn_count, count(*) filter (severity = 'info') as info_count, {near_sql('avg(impact_score)')} as avg_impact, {near_sql('max(impact_score)')} as max_impact from ins group by rule_id")
def insight_families(spark, sf):
    return rounded(rules.family_summary(rules.insights(slow(spark, sf), risk(spark, sf))), "avg_impact", "max_impact")


@query("rewrites", f"{with_(*BASE)}, {SLOW}, {RISK}, {QOP}, {TOP}, {REWRITES} select {_FOUND} from rew")
def rewrites(spark, sf):
    return _found(rules.rewrites(slow(spark, sf), risk(spark, sf)))


@query("table_risk", f"{with_('tables')}, {RISK} select table_id, table_key, {near_sql('table_risk_score')} as table_risk_score from risk")
def table_risk(spark, sf):
    return rounded(risk(spark, sf).select("table_id", "table_key", "table_risk_score"), "table_risk_score")


def references(spark, sf):
    return gold.table_references(relation(spark, sf, "statements"), risk(spark, sf))


@query("table_references", f"{with_(*BASE)}, {SLOW}, {RISK}, {REFS} select query_id, table_id, strength from refs")
def table_references(spark, sf):
    return references(spark, sf).select("query_id", "table_id", "strength")


@query("table_references_contained", f"{with_('statements', 'tables')}, {RISK} select query_id, table_id from statements join risk on contains(lower(sql_text), schema_name || '.' || lower(table_name))")
def table_references_contained(spark, sf):
    return gold.table_references_contained(relation(spark, sf, "statements"), risk(spark, sf)).select("query_id", "table_id")


_IMPACT = ["total_elapsed_s", "avg_elapsed_s", "max_elapsed_s", "max_query_risk", "blast_radius_score"]


@query("table_impact", f"{with_(*BASE)}, {SLOW}, {RISK}, {REFS}, {_impact('total_elapsed_s')} select * exclude (risk, {', '.join(_IMPACT)}), {_r(*_IMPACT, digits=3)} from impact")
def table_impact(spark, sf):
    return rounded(gold.table_impact(references(spark, sf), slow(spark, sf)).drop("risk"), *_IMPACT, digits=3)


@query("table_impact_fast", f"{with_(*BASE)}, {SLOW}, {RISK}, {REFS}, {_impact('avg_elapsed_s')} select table_id, {near_sql('blast_radius_score', 3)} as blast_radius_score from impact")
def table_impact_fast(spark, sf):
    return rounded(gold.table_impact(references(spark, sf), slow(spark, sf), fast=True).select("table_id", "blast_radius_score"), "blast_radius_score", digits=3)


_SCORES = ["sort_key_usage", "full_scan_score", "distribution_usage_score", "sort_attention_score", "table_attention_score"]
_Z = lambda c: f"coalesce({c}, 0)"
REVIEW = f"""rev as (select r.table_id, r.table_key, r.stats_off, r.unsorted_pct, r.vacuum_sort_benefit, r.skew_rows, r.table_risk_score, coalesce(slow_query_count, 0) as slow_query_count, coalesce(redistribution_count, 0) as redistribution_count, coalesce(blast_radius_score, 0) as blast_radius_score,
 case when {_MISSING} then 0 else 100 * {_Z("rrscan_query_pct")} end as sort_key_usage, least(60 * {_Z("full_scan_query_pct")} + least(6 * {_Z("non_rrscan_queries")}, 30) + least({_Z("scan_input_rows_m")} / 100, 30), 120) as full_scan_score,
 least(10 * {_Z("redistribution_count")} + 8 * {_Z("broadcast_count")} + 8 * {_Z("skewed_count")} + least(6 * skew_rows, 35), 120) as distribution_usage_score,
 least(case when {_MISSING} and {_Z("scan_query_count")} > 0 then 30 else 0 end + 0.7 * unsorted_pct + 0.7 * vacuum_sort_benefit + 35 * (1 - {_Z("rrscan_query_pct")}), 120) as sort_attention_score,
 least({_Z("blast_radius_score")} + least({_Z("scan_duration_s")} / 3600, 30) + least(4 * {_Z("non_rrscan_queries")}, 30) + least({_Z("scan_input_rows_m")} / 120, 25), 180) as table_attention_score
 from risk r left join (select * exclude (risk) from impact) i using (table_id) left join tsc using (table_key))"""


def review(spark, sf):
    return gold.table_review(risk(spark, sf), gold.table_impact(references(spark, sf), slow(spark, sf)), rollups.table_scans(relation(spark, sf, "scans")))


@query("table_review", f"{with_(*BASE, 'scans')}, {SLOW}, {RISK}, {REFS}, {_impact('total_elapsed_s')}, {SCANS}, {REVIEW} select table_id, {_r(*_SCORES, digits=3)} from rev")
def table_review(spark, sf):
    return rounded(review(spark, sf).select("table_id", *_SCORES), *_SCORES, digits=3)


_FAST = f"""tel as (select t_id, count(*) as telemetry_queries from (select cast(table_id as varchar) as t_id, query_id from steps where table_id is not null group by all) group by t_id),
fr as (select r.table_id, r.table_key, r.table_name, r.table_risk_score, r.stats_off, r.unsorted_pct, r.vacuum_sort_benefit, r.skew_rows, coalesce(scan_query_count, 0) as scan_query_count, coalesce(non_rrscan_queries, 0) as non_rrscan_queries, coalesce(scan_input_rows_m, 0) as scan_input_rows_m,
 greatest(coalesce(telemetry_queries, 0), coalesce(scan_query_count, 0)) as slow_query_count, coalesce(scan_duration_s / scan_query_count, 0) as avg_scan_s, least(6 * skew_rows, 35) as distribution_usage_score,
 case when coalesce(scan_query_count, 0) > 0 then least(case when {_MISSING} then 30 else 0 end + 0.7 * unsorted_pct + 0.7 * vacuum_sort_benefit + 35 * (1 - {_Z("rrscan_query_pct")}), 120) else 0 end as sort_attention_score,
 least(table_risk_score + least({_Z("scan_duration_s")} / 3600, 30) + least(4 * {_Z("non_rrscan_queries")}, 30) + least({_Z("scan_input_rows_m")} / 120, 25), 180) as table_attention_score
 from risk r left join tsc using (table_key) left join tel on tel.t_id = cast(r.table_id as varchar))"""


def fast(spark, sf):
    return gold.fast_review(risk(spark, sf), rollups.table_scans(relation(spark, sf, "scans")), gold.table_telemetry(relation(spark, sf, "steps")))


@query("table_review_fast", f"{with_('steps', 'tables', 'scans')}, {RISK}, {SCANS}, {_FAST} select table_id, cast(slow_query_count as double) as slow_query_count, {_r('avg_scan_s', 'distribution_usage_score', 'sort_attention_score', 'table_attention_score', digits=3)} from fr")
def table_review_fast(spark, sf):
    names = ["avg_scan_s", "distribution_usage_score", "sort_attention_score", "table_attention_score"]
    return rounded(fast(spark, sf).select("table_id", "slow_query_count", *names), *names, digits=3)


@query("table_telemetry", f"{with_('steps')} select t_id, count(*) as telemetry_queries, count(*) filter (skew >= 4) as telemetry_skewed, count(*) filter (spill > 0) as telemetry_spilling from (select cast(table_id as varchar) as t_id, query_id, max(data_skewness) as skew, sum(spill_local + spill_remote) as spill from steps group by all) group by t_id")
def table_telemetry(spark, sf):
    return gold.table_telemetry(relation(spark, sf, "steps"))


def _acts(catalogue, source, scope, subject):
    return union_of(catalogue, source, scope, subject)


ACTIONS = f"""act as (select scope, subject, rule_id, severity, impact_score as action_score from ({_acts(rules.TABLE_ACTIONS, "rev", "table", "table_id")} union all {_acts(rules.QUERY_ACTIONS, "qo", "query", "query_id")})
 union all select scope, subject, 'A05_' || left(rule_id, 3), severity, impact_score from rew where scope = 'query' and impact_score >= 80)"""
_ALL = f"{with_(*BASE, 'scans')}, {SLOW}, {RISK}, {REFS}, {_impact('total_elapsed_s')}, {SCANS}, {REVIEW}, {QOP}, {TOP}, {REWRITES}, {ACTIONS}"


def acts(spark, sf):
    return gold.actions(slow(spark, sf), review(spark, sf))


@query("actions", f"{_ALL} select scope, subject, rule_id, severity, {near_sql('action_score', 3)} as action_score from act")
def actions(spark, sf):
    return rounded(acts(spark, sf), "action_score", digits=3)


@query("action_queue", f"{_ALL}, q as (select scope, subject, rule_id, severity, {near_sql('action_score', 3)} as action_score from act order by 5 desc, 2, 3 limit 200) select *, row_number() over (order by action_score desc, subject, rule_id) as priority_rank from q")
def action_queue(spark, sf):
    return gold.ranked(rounded(acts(spark, sf), "action_score", digits=3), "action_score")


@query("action_queue_by_snapshot", f"{_ALL}, q as (select right(subject, 1) as snapshot_id, scope, subject, rule_id, severity, {near_sql('action_score', 3)} as action_score from act) select *, row_number() over (partition by snapshot_id order by action_score desc nulls last, subject, rule_id) as priority_rank from q qualify priority_rank <= 200")
def action_queue_by_snapshot(spark, sf):
    found = rounded(acts(spark, sf), "action_score", digits=3).select(F.right("subject", F.lit(1)).alias("snapshot_id"), "*")
    return gold.ranked_by(found, "snapshot_id", "action_score")


@query("report_summary", f"""{_ALL}, ins as ({union_of(rules.QUERY_RULES, 'qo', 'query', 'query_id')} union all {union_of(rules.TABLE_RULES, 'top', 'table', 'table_id')})
 select (select count(*) from slow) as queries, (select {near_sql('sum(coalesce(elapsed_s, 0))', 1)} from slow) as total_elapsed_s, (select {near_sql('max(risk_score)', 3)} from slow) as max_risk, (select count(*) from slow where total_spill > 0) as spilling_queries,
 (select count(*) from risk) as tables, (select count(*) from risk where table_risk_score >= 50) as high_risk_tables, (select count(*) from ins) as findings, (select count(*) from ins where severity = 'crit') as critical_findings, (select count(*) from act) as actions""")
def report_summary(spark, sf):
    found = storage.summary(slow(spark, sf), risk(spark, sf), review(spark, sf))
    return rounded(rounded(found, "total_elapsed_s", digits=1), "max_risk", digits=3)


@query("actions_fast", f"{with_('steps', 'tables', 'scans')}, {RISK}, {SCANS}, {_FAST}, fa as ({_acts(rules.FAST_ACTIONS, 'fr', 'table', 'table_id')}) select subject, rule_id, severity, {near_sql('impact_score', 3)} as action_score from fa")
def actions_fast(spark, sf):
    found = rules.fired(rules.table_operands(fast(spark, sf)), rules.FAST_ACTIONS, ["table_id"])
    return found.select(F.col("table_id").cast("string").alias("subject"), "rule_id", "severity", near("impact_score", 3).alias("action_score"))
