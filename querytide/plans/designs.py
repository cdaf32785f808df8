"""Queries over verdicts, design advice, steps and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import grouping, rollups, triage
from ..sources.adapter import relation, with_
from . import core
from .core import RISK, SCANS, _r, near_sql, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


_META = "regexp_replace(lower(trim(coalesce(sortkey1, ''))), '\\s+', '', 'g') in (" + ", ".join(f"'{x}'" for x in exprs.MISSING_KEY_META) + ")"


def catalog(spark, sf) -> DataFrame:
    return core.risk(spark, sf)


def scanned(spark, sf) -> DataFrame:
    """Catalogue and scans."""
    t = core.risk(spark, sf)
    scans = rollups.table_scans(relation(spark, sf, "scans")).withColumn("table_key", F.concat_ws(".", "table_database", "schema_name", "table_name")).drop("table_database", "schema_name", "table_name")
    return t.join(scans, "table_key", "left")


def reviewed(spark, sf) -> DataFrame:
    """Catalogue, impact and scans with the attention scores, from all tables."""
    return core.review(spark, sf)


_W = with_("patterns", "tables", "scans") + f", {RISK}, {SCANS}, rev as (select r.*, tsc.* exclude (table_key) from risk r left join tsc using (table_key))"
_SCORED = f"""{with_('patterns', *core.BASE, 'scans')}, {core.SLOW}, {RISK}, {core.REFS}, {core._impact('total_elapsed_s')}, {SCANS}, {core.REVIEW.replace('rev as (', 'scored as (', 1)},
rev as (select r.*, tsc.* exclude (table_key), sort_attention_score, full_scan_score, distribution_usage_score, scored.redistribution_count, coalesce(broadcast_count, 0) as broadcast_count from risk r join scored using (table_id) left join tsc on tsc.table_key = r.table_key left join impact using (table_id))"""
FLAGS = """qf as (select *, (case when wildcard_count > 0 then 1 else 0 end + case when join_count > 0 and predicate_count = 0 then 1 else 0 end + case when avg_total_spill > 0 then 1 else 0 end + case when avg_has_nested_loop >= 0.3 then 1 else 0 end + case when avg_dist_both_cnt >= 0.5 then 1 else 0 end
 + case when avg_bcast_cnt >= 0.5 then 1 else 0 end + case when avg_remote_io_ratio >= 0.3 then 1 else 0 end + case when greatest(avg_max_data_skewness, avg_max_time_skewness) >= 4 then 1 else 0 end + case when avg_selectivity_ratio >= 0.9 and predicate_count = 0 then 1 else 0 end) as query_flag_count from patterns)"""
TFLAGS = f"""tf as (select *, (case when {_META} and size_mb >= 100 then 1 else 0 end + case when unsorted_pct >= 20 then 1 else 0 end + case when stats_off >= 10 then 1 else 0 end + case when coalesce(rrscan_query_pct, 1) <= 0.5 and coalesce(scan_query_count, 0) >= 3 then 1 else 0 end + case when coalesce(full_scan_query_pct, 0) >= 0.5 then 1 else 0 end
 + case when (upper(diststyle) like 'EVEN%' or upper(diststyle) like 'ALL%') and size_mb >= 1000 then 1 else 0 end + case when skew_rows >= 4 then 1 else 0 end) as flags from rev)"""
HIT = """men as (select *, unnest(string_split(sql_tables, ', ')) as mention from patterns), hit as (select men.*, tf.table_id, tf.flags from men left join tf on lower(mention) = lower(tf.schema_name || '.' || tf.table_name))"""


@query("triage_query_flags", f"{with_('patterns')}, {FLAGS} select repeat_group_id, query_flag_count from qf")
def triage_query_flags(spark, sf):
    return triage.group_flags(relation(spark, sf, "patterns")).select("repeat_group_id", F.size("query_flags").alias("query_flag_count"))


@query("triage_table_flags", f"{_W}, {TFLAGS} select table_id, flags from tf")
def triage_table_flags(spark, sf):
    return triage.table_flags(scanned(spark, sf)).select("table_id", F.size("table_flags").alias("flags"))


@query("triage_verdicts", f"{_W}, {FLAGS}, {TFLAGS}, {HIT}, per as (select repeat_group_id, count(mention) as named, count(table_id) as matched, coalesce(sum(flags), 0) as table_flag_count from hit group by 1) select repeat_group_id, case when query_flag_count > 0 and table_flag_count > 0 then 'FIX BOTH' when query_flag_count > 0 then 'FIX QUERY' when table_flag_count > 0 then 'FIX TABLES' else 'MONITOR' end as verdict, case when matched = named then 'complete' when matched > 0 then 'partial' else 'none' end as coverage, {near_sql('(total_runtime_s + 10 * sqrt(query_count)) * case when avg_total_spill > 0 then 1.25 else 1 end + least(total_input_rows / 1e7, 50)', 1)} as triage_priority_score from qf join per using (repeat_group_id)")
def triage_verdicts(spark, sf):
    found = triage.verdicts(relation(spark, sf, "patterns"), scanned(spark, sf))
    return rounded(found.select("repeat_group_id", "verdict", "coverage", "triage_priority_score"), "triage_priority_score", digits=1)


STATS = """us as (select table_id, repeat_group_id, total_runtime_s, 'filter' as use, unnest(list_distinct(list_transform(regexp_split_to_array(sql_filter_columns, '[,;|]\\s*'), lambda x: string_split(lower(trim(x)), '.')[-1]))) as col from hit where table_id is not null
 union all select table_id, repeat_group_id, total_runtime_s, 'join', unnest(list_distinct(list_transform(list_filter(regexp_split_to_array(sql_join_columns, '[,;|]\\s*'), lambda x: x <> ''), lambda x: string_split(lower(trim(x)), '.')[-1]))) from hit where table_id is not null),
stats as (select table_id, col as "column", use, count(distinct repeat_group_id) as patterns, sum(total_runtime_s) as runtime_s from us group by all)"""


def stats(spark, sf) -> DataFrame:
    return triage.structural_stats(relation(spark, sf, "patterns"), catalog(spark, sf))


@query("structural_stats", f'{_W}, {TFLAGS}, {HIT}, {STATS} select table_id, "column", use, patterns, runtime_s from stats')
def structural_stats(spark, sf):
    return stats(spark, sf)


SORT = f"""so as (select rev.*, s."column" as sort_column, s.patterns, coalesce(sort_attention_score, 0) + 0.5 * full_scan_score + least(s.runtime_s / 3600, 35) + least(5 * s.patterns, 25) + 25 * greatest(0, 1 - coalesce(rrscan_query_pct, 0)) + 20 * coalesce(full_scan_query_pct, 0) as pressure
 from rev join (select * from stats where use = 'filter' qualify row_number() over (partition by table_id order by runtime_s desc, patterns desc, "column") = 1) s using (table_id)),
sortkey as (select table_id, 'SORTKEY' as kind, sort_column as "column", pressure, case when pressure >= 115 or {_META} then 'crit' else 'warn' end as severity from so where size_mb >= 100 and (coalesce(scan_query_count, 0) >= 1 or patterns >= 2) and lower(coalesce(sortkey1, '')) <> sort_column and (pressure >= 45 or {_META}))"""
DIST = """di as (select rev.*, s."column" as dist_column, distribution_usage_score + least(s.runtime_s / 3600, 40) + least(6 * s.patterns, 36) + least(4 * redistribution_count, 35) + least(3 * broadcast_count, 25) + case when size_mb >= 1024 then 20 else 0 end as pressure
 from rev join (select * from stats where use = 'join' qualify row_number() over (partition by table_id order by runtime_s desc, patterns desc, "column") = 1) s using (table_id)),
distkey as (select table_id, 'DISTKEY' as kind, dist_column as "column", pressure, case when pressure >= 120 or redistribution_count >= 5 then 'crit' else 'warn' end as severity from di where pressure >= 45 and regexp_extract(lower(diststyle), 'key\\s*\\(?\\s*([a-z_][a-z0-9_$]*)', 1) <> dist_column
 union all select table_id, 'ALL_REVIEW', '', least(pressure, 80) + least(size_mb / 1024, 20), 'warn' from di where upper(diststyle) like 'ALL%' and size_mb >= 2048
 union all select table_id, 'SKEW_REVIEW', '', 85 + least(6 * skew_rows, 45), 'warn' from rev where skew_rows >= 4)"""


@query("sortkey_advice", f'{_SCORED}, {TFLAGS}, {HIT}, {STATS}, {SORT} select table_id, kind, "column", severity, {near_sql("pressure", 3)} as pressure from sortkey')
def sortkey_advice(spark, sf):
    return rounded(triage.sortkey_advice(stats(spark, sf), reviewed(spark, sf)), "pressure", digits=3)


@query("distkey_advice", f'{_SCORED}, {TFLAGS}, {HIT}, {STATS}, {DIST} select table_id, kind, "column", severity, {near_sql("pressure", 3)} as pressure from distkey')
def distkey_advice(spark, sf):
    return rounded(triage.distkey_advice(stats(spark, sf), reviewed(spark, sf)), "pressure", digits=3)


@query("recommendation_ranking", f'{_SCORED}, {TFLAGS}, {HIT}, {STATS}, {SORT}, {DIST}, al as (select table_id, kind, {near_sql("pressure", 3)} as pressure from (select * from sortkey union all select * from distkey)) select *, row_number() over (order by pressure desc, table_id, kind) as rank from al order by pressure desc, table_id, kind limit 300')
def recommendation_ranking(spark, sf):
    from pyspark.sql import Window as W

    s, r = stats(spark, sf), reviewed(spark, sf)
    both = rounded(triage.sortkey_advice(s, r).unionByName(triage.distkey_advice(s, r)), "pressure", digits=3).select("table_id", "kind", "pressure")
    order = [F.desc("pressure"), F.asc("table_id"), F.asc("kind")]
    return both.orderBy(*order).limit(300).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


_DEMAND = """w as (select *, greatest(1.0, total_runtime_s / 3600) * greatest(1, query_count) as weight, unnest(string_split(sql_tables, ', ')) as t from patterns),
u as (select repeat_group_id, t, 'filter' as kind, weight as w, unnest(regexp_split_to_array(sql_filter_columns, '[,;|]\\s*')) as c from w union all select repeat_group_id, t, 'join', weight * 0.4, unnest(list_filter(regexp_split_to_array(sql_join_columns, '[,;|]\\s*'), lambda x: x <> '')) from w),
demand as (select lower(t) as table_name, string_split(lower(trim(c)), '.')[-1] as "column", sum(w) as demand, count(distinct repeat_group_id) as pattern_count, sum(case when kind = 'filter' then w else 0 end) as filter_demand from u group by 1, 2)"""


@query("column_demand", f'{with_("patterns")}, {_DEMAND} select table_name, "column", pattern_count, {_r("demand", "filter_demand", digits=3)} from demand')
def column_demand(spark, sf):
    return rounded(grouping.column_demand(relation(spark, sf, "patterns")), "demand", "filter_demand", digits=3)


@query("table_scenarios", f'{_W}, {_DEMAND}, best as (select *, row_number() over (partition by table_name order by demand desc, "column") as n from demand), wanted as (select table_name, list("column" order by n) as ws from best where n <= 3 group by 1) select table_id, cast(case when ws is null then null when {_META} then 0 when ws[1] = lower(sortkey1) then 100 when list_contains(ws, lower(sortkey1)) then 70 else 30 end as bigint) as sort_key_fit, cast(case when skew_rows >= 4 then 0 when upper(diststyle) like \'KEY%\' then 100 when upper(diststyle) like \'ALL%\' and size_mb >= 1024 then 30 else 70 end as bigint) as distribution_fit, cast(least(unsorted_pct / 2 + stats_off + vacuum_sort_benefit, 100) as double) as maintenance_debt from rev left join wanted on wanted.table_name = lower(rev.schema_name || \'.\' || rev.table_name)')
def table_scenarios(spark, sf):
    r = scanned(spark, sf).withColumn("table_name", F.concat_ws(".", "schema_name", "table_name"))
    return triage.scenarios(r, grouping.column_demand(relation(spark, sf, "patterns"))).select("table_id", "sort_key_fit", "distribution_fit", "maintenance_debt")


@query("fix_script", f"""{_SCORED}, {TFLAGS}, {HIT}, {STATS}, {SORT}, {DIST} select 'maintenance' as section, table_id, 1 as step, 'ANALYZE ' || table_key || ';' as line from rev where stats_off >= 10 union all select 'maintenance', table_id, 2, 'VACUUM SORT ONLY ' || table_key || ';' from rev where unsorted_pct >= 20 or vacuum_sort_benefit >= 10
 union all select 'design', table_id, case kind when 'SORTKEY' then 1 when 'DISTKEY' then 2 else 3 end, case kind when 'SORTKEY' then '-- ALTER TABLE ' || table_key || ' ALTER SORTKEY (' || a."column" || ');' when 'DISTKEY' then '-- ALTER TABLE ' || table_key || ' ALTER DISTKEY ' || a."column" || ';' else '-- review ' || lower(kind) || ' of ' || table_key end from (select * from sortkey union all select * from distkey) a join rev using (table_id)""")
def fix_script(spark, sf):
    s, r = stats(spark, sf), reviewed(spark, sf)
    return triage.fix_script(r, triage.sortkey_advice(s, r).unionByName(triage.distkey_advice(s, r))).select("section", "table_id", "step", "line")


_CAT = "case when contains(lower(step_name), 'join') then 'join' when contains(lower(step_name), 'dist') or contains(lower(step_name), 'bcast') then 'redistribute' when contains(lower(step_name), 'aggr') then 'aggregate' when contains(lower(step_name), 'sort') then 'sort' when contains(lower(step_name), 'scan') then 'scan' else 'other' end"


# the relation's steps move no rows: every fourth of them, by its place, stands for a redistribution of its successor's table
_MOVED = """moved as (select * replace (case when step_id % 4 = 1 and query_id % 3 = 0 then 'dist inner' when step_id % 4 = 3 and query_id % 3 = 0 then 'hash join' else step_name end as step_name, case when step_id % 4 = 3 and query_id % 3 = 0 and query_id % 2 = 0 then (query_id % 25) else case when step_id % 4 = 1 and query_id % 3 = 0 then (query_id % 25) else table_id end end as table_id) from steps)"""


def moved(spark, sf) -> DataFrame:
    s, third = relation(spark, sf, "steps"), F.col("query_id") % 3 == 0
    dist, join = third & (F.col("step_id") % 4 == 1), third & (F.col("step_id") % 4 == 3)
    table = F.when(dist | (join & (F.col("query_id") % 2 == 0)), F.col("query_id") % 25).otherwise(F.col("table_id"))
    return s.withColumns({"step_name": F.when(dist, "dist inner").when(join, "hash join").otherwise(F.col("step_name")), "table_id": table})


@query("step_diagnosis", f"""{with_("steps", "tables")}, {_MOVED}, e as (select s.*, unsorted_pct, stats_off, diststyle, {_CAT} as category, lag({_CAT}) over w as before, lag(table_id) over w as table_before from moved s left join tables using (table_id) window w as (partition by query_id, stream_id, segment_id order by step_id, table_id nulls last, duration desc)),
f as (select query_id, min(step_id) as step_id, 'REDISTRIBUTION' as finding, case when sum(duration) filter (category = 'redistribute') / cast(sum(duration) as double) > 0.4 then 'crit' else 'warn' end as severity from e group by query_id having sum(duration) filter (category = 'redistribute') / cast(sum(duration) as double) >= 0.15
 union all select query_id, step_id, 'DISTKEY_MISMATCH', 'crit' from e where category = 'join' and contains(upper(diststyle), 'KEY') and before = 'redistribute' and table_before = table_id
 union all select query_id, step_id, 'UNSORTED_SCAN' as finding, case when unsorted_pct >= 50 then 'crit' else 'warn' end as severity from e where category = 'scan' and unsorted_pct >= 20 and input_rows > 1000000
 union all select query_id, step_id, 'STALE_STATS', case when stats_off >= 25 then 'crit' else 'warn' end from e where stats_off >= 10
 union all select query_id, step_id, 'SKEW', case when data_skewness >= 5 then 'crit' else 'warn' end from e where data_skewness >= 3
 union all select query_id, step_id, 'REMOTE_SPILL', 'crit' from e where spill_remote > 0 union all select query_id, step_id, 'LOCAL_SPILL', 'warn' from e where spill_local > 1000 union all select query_id, step_id, 'ALERT', 'warn' from e where alert is not null)
 select query_id, finding, severity, count(*) as n from f group by all""")
def step_diagnosis(spark, sf):
    found = triage.step_findings(triage.enriched_steps(moved(spark, sf), relation(spark, sf, "tables")))
    return found.groupBy("query_id", "finding", "severity").agg(F.count("*").alias("n"))


@query("step_previous", f"{with_('steps')}, d as (select query_id, stream_id, segment_id, step_id, min(step_name) as step_name, sum(duration) as duration from steps group by all) select query_id, step_id, lag(step_name) over (partition by query_id, stream_id, segment_id order by step_id) as previous_step, {near_sql('100.0 * duration / cast(sum(duration) over (partition by query_id) as double)', 3)} as pct_runtime from d")
def step_previous(spark, sf):
    d = relation(spark, sf, "steps").groupBy("query_id", "stream_id", "segment_id", "step_id").agg(F.min("step_name").alias("step_name"), F.sum("duration").alias("duration"), F.min("table_id").alias("table_id"))
    found = triage.enriched_steps(d, relation(spark, sf, "tables"))
    return rounded(found.select("query_id", "step_id", "previous_step", "pct_runtime"), "pct_runtime", digits=3)


EVID = r"""ev as (select * from (select query_id, plan_node_id, plan_node, try_cast(regexp_extract(plan_node, '\brows=(\d+)', 1) as bigint) as planned_rows from plans) full outer join (select query_id, step_id as plan_node_id, sum(output_rows) as output_rows, sum(case when query_id % 5 = 0 then input_bytes * 1000000 else input_bytes end) as input_bytes, sum(spill_local + spill_remote) as spill_blocks, max(data_skewness) as skew from steps group by all) using (query_id, plan_node_id)),
pf as (select query_id, plan_node_id, 'BROADCAST' as finding, case when output_rows >= 100000000 then 'crit' else 'warn' end as severity from ev where contains(lower(plan_node), 'bcast') and output_rows >= 1000000
 union all select query_id, plan_node_id, 'SPILL', case when spill_blocks * 1048576 >= 10000000000 then 'high' else 'warn' end from ev where spill_blocks * 1048576 >= 1000000000
 union all select query_id, plan_node_id, 'ESTIMATE_ERROR', 'warn' from ev where greatest(case when planned_rows > 0 then coalesce(output_rows, 0) / cast(planned_rows as double) end, case when output_rows > 0 then planned_rows / cast(output_rows as double) end) >= 100
 union all select query_id, plan_node_id, 'WIDE_SCAN', 'warn' from ev where contains(lower(plan_node), 'scan') and input_bytes >= 50000000000 and input_bytes / cast(greatest(coalesce(output_rows, 0), 1) as double) > 10000
 union all select query_id, plan_node_id, 'SKEW', 'warn' from ev where skew >= 4)"""


def wide(steps: DataFrame) -> DataFrame:
    """Steps whose scans read wide rows: the bytes of every fifth query a million times over."""
    return steps.withColumn("input_bytes", F.when(F.col("query_id") % 5 == 0, F.col("input_bytes") * 1_000_000).otherwise(F.col("input_bytes")))


@query("plan_findings", f"{with_('plans', 'steps')}, {EVID} select query_id, finding, severity, count(*) as n from pf group by all")
def plan_findings(spark, sf):
    d = wide(relation(spark, sf, "steps")).withColumnRenamed("step_id", "plan_node_id")
    found = triage.plan_findings(triage.plan_evidence(relation(spark, sf, "plans"), d))
    return found.groupBy("query_id", "finding", "severity").agg(F.count("*").alias("n"))


@query("unkeyed_tables", f"""{with_('tables')}, k as (select *, regexp_extract(lower(diststyle), 'key\\s*\\(?\\s*([a-z_][a-z0-9_$]*)', 1) = '' as no_dist, {_META} as no_sort from tables)
 select table_id, 'TABLE_UNKEYED' as finding, case when no_dist then 'high' else 'medium' end as severity from k where (no_dist or no_sort) and (tbl_rows >= 1000000 or size_mb >= 1024)
 union all select table_id, 'TABLE_SKEW', 'high' from k where (no_dist or no_sort) and (tbl_rows >= 1000000 or size_mb >= 1024) and skew_rows >= 4""")
def unkeyed_tables(spark, sf):
    return triage.unkeyed_findings(relation(spark, sf, "tables")).select("table_id", "finding", "severity")


@query("findings_ranking", f"""{with_('plans', 'steps', 'tables')}, {EVID}, m as (select query_id, plan_node_id, finding, severity, case severity when 'crit' then 3 when 'high' then 2 else 1 end as weight from pf)
 select *, row_number() over (order by weight desc, finding, query_id, plan_node_id) as place from m order by weight desc, finding, query_id, plan_node_id limit 200""")
def findings_ranking(spark, sf):
    d = wide(relation(spark, sf, "steps")).withColumnRenamed("step_id", "plan_node_id")
    found = triage.plan_findings(triage.plan_evidence(relation(spark, sf, "plans"), d)).withColumn("tier", F.lit(1)).withColumn("evidence", F.lit(True))
    return triage.ranked_findings(found, ["finding", "query_id", "plan_node_id"]).select("query_id", "plan_node_id", "finding", "severity", "weight", "place")


@query("table_health", f"{with_('tables')} select table_id, case when skew_rows >= 4 then 2 when upper(diststyle) like 'EVEN%' or upper(diststyle) like 'AUTO%' then 1 else 0 end as dist_health, case when {_META} or unsorted_pct > 90 then 2 when unsorted_pct >= 50 then 1 else 0 end as sort_health, greatest(case when skew_rows >= 4 then 2 when upper(diststyle) like 'EVEN%' or upper(diststyle) like 'AUTO%' then 1 else 0 end, case when {_META} or unsorted_pct > 90 then 2 when unsorted_pct >= 50 then 1 else 0 end) as health, 100 - stats_off <= 60 as stats_alert from tables")
def table_health(spark, sf):
    return triage.health(relation(spark, sf, "tables"))


@query("query_categories", f"{with_('patterns')} select case when repeat_kind = 'proc' then 'sproc' when query_type in ('UTILITY', 'DDL') then 'utility' when avg_s3_scan_cnt > 0 then 'spectrum' else 'plain' end as category, count(*) as n from patterns group by 1")
def query_categories(spark, sf):
    g = relation(spark, sf, "patterns")
    return g.groupBy(triage.category(g).alias("category")).agg(F.count("*").alias("n"))


# What the relation lacks: bytes, output rows, and what tables a group touches
_MORE = {"total_input_bytes": "total_input_rows * 96", "total_output_rows": "total_input_rows * (query_count % 7) div 10", "mixed_query_class": "case when query_count % 3 = 0 then 'Mixed' end", "uses_view": "query_count % 5 = 0"}
_PER = """per as (select *, total_runtime_s / greatest(query_count, 1) as runtime, total_input_rows / cast(greatest(query_count, 1) as double) as rpr, total_input_rows * 96 / cast(greatest(query_count, 1) as double) as bpr, (total_input_rows * (query_count % 7) // 10) / cast(total_input_rows as double) as share,
 total_queue_s / greatest(query_count, 1) as queue, greatest(avg_max_data_skewness, avg_max_time_skewness) as skew, avg_dist_both_cnt + avg_bcast_cnt as moved from patterns)"""


def _chart(name: str, where: str, score: str, scenario: str, **filters) -> None:
    text = f"{with_('patterns')}, {_PER}, sc as (select repeat_group_id, {near_sql('runtime', 6)} as runtime, total_runtime_s, {near_sql(score, 6)} as chart_score from per where {where}) select repeat_group_id, chart_score from sc order by chart_score desc, runtime desc, total_runtime_s desc, repeat_group_id limit 200"

    @query(name, text)
    def run(spark, sf):
        g = relation(spark, sf, "patterns").withColumns({k: F.expr(v) for k, v in _MORE.items()})
        found = triage.chart(g, scenario, 1 << 30, **filters)
        return rounded(found, "chart_score", "runtime", digits=6).orderBy(F.desc("chart_score"), F.desc("runtime"), F.desc("total_runtime_s"), "repeat_group_id").limit(200).select("repeat_group_id", "chart_score")


_chart("chart_overview", "true", "runtime", "overview")
_chart("chart_slow_light", "runtime >= 10 and rpr <= (select median(rpr) from per where rpr > 0) and avg_total_spill <= 0", "runtime / (1 + log10(1 + rpr))", "slow_light")
_chart("chart_spill_slow", "avg_total_spill > 0", "runtime * (1 + log10(1 + avg_total_spill))", "spill_slow")
_chart("chart_io_shuffle", "moved > 0 and bpr > 0 and share <= 0.25", "runtime * (1 + moved) * (1 + log10(1 + bpr)) * (2 - share)", "io_shuffle")
_chart("chart_queue_bound", "queue > 0", "queue * (1 + queue / greatest(runtime, 0.001))", "queue_bound")
_chart("chart_skew_remote", "skew >= 4 or avg_remote_io_ratio >= 0.3 or avg_s3_scan_cnt > 0", "runtime * (1 + skew + 10 * avg_remote_io_ratio + avg_s3_scan_cnt)", "skew_remote")
_chart("chart_categories", "runtime >= 500 and (repeat_kind = 'proc' or query_count % 3 = 0 or query_count % 5 = 0)", "runtime", "overview", categories={"sproc", "mixed", "view"}, least_s=500.0)


@query("issue_matrix", f"{with_(*core.BASE)}, {core.SLOW}, {RISK}, {core.QOP}, {core.TOP}, {core.INSIGHTS}, t as (select cast(query_id as varchar) as subject from (select query_id, {near_sql('risk_score')} as risk_score from slow) order by risk_score desc nulls last, query_id limit 40) select subject, left(rule_id, 24) as family, cast(max(case when impact_score >= 80 then 3 when impact_score >= 50 then 2 else 1 end) as bigint) as level from ins join t using (subject) where scope = 'query' group by all")
def issue_matrix(spark, sf):
    from ..operators import rules

    s = core.slow(spark, sf)
    return triage.issue_matrix(rounded(s, "risk_score"), rules.insights(s, core.risk(spark, sf)))


@query("name_resolution", f"{with_('patterns', 'tables')}, {RISK}, men as (select repeat_group_id, unnest(string_split(sql_tables, ', ')) as mention from patterns) select repeat_group_id, mention, table_id from men left join risk on lower(mention) = schema_name || '.' || lower(table_name)")
def name_resolution(spark, sf):
    mentions = relation(spark, sf, "patterns").select("repeat_group_id", F.explode(exprs.split_names("sql_tables")).alias("mention"))
    return triage.resolved(mentions, catalog(spark, sf)).select("repeat_group_id", "mention", "table_id")


@query("name_resolution_best", f"{with_('tables')}, {RISK}, k as (select table_id, table_risk_score, unnest([table_key, schema_name || '.' || lower(table_name), lower(table_name)]) as suffix from risk), m as (select distinct 'PART' as m) select split_part(suffix, '_', 1) as stem, count(*) as n, count(distinct suffix) as suffixes from k group by 1")
def name_resolution_best(spark, sf):
    k = catalog(spark, sf).select(F.explode(triage.suffixes(F.col("table_key"))).alias("suffix"))
    return k.groupBy(F.split_part("suffix", F.lit("_"), F.lit(1)).alias("stem")).agg(F.count("*").alias("n"), F.countDistinct("suffix").alias("suffixes"))


# Two copies of every second table in another database; mentions in five forms, of queries in three databases or none
_COPIES = "cat2 as (select source_db, schema_name, table_name, table_id from tables union all select 'db' || cast((table_id + 1) % 3 as varchar(20)), schema_name, table_name, -table_id from tables where table_id % 2 = 0), dbcat as (select source_db, schema_name, table_name, lower(source_db || '.' || schema_name || '.' || table_name) as table_key from cat2)"
_SAID = """said as (select h.query_id, case when h.query_id % 7 = 0 then '' else h.database_name end as database_name, case h.query_id % 5 when 0 then 'db' || cast(h.query_id % 4 as varchar(20)) || '.' || schema_name || '.' || table_name when 1 then upper(schema_name || '.' || table_name) when 2 then table_name when 3 then '"' || schema_name || '"."' || table_name || '"' else 'nowhere.' || table_name end as mention
 from history h join tables t on t.table_id = h.query_id % 1500 + 1)"""


@query(
    "database_name_resolution",
    f"""{with_("history", "tables")}, {_COPIES}, {_SAID}, q as (select *, string_split(replace(lower(mention), '"', ''), '.') as p from said),
 one as (select schema_name || '.' || lower(table_name) as f, min(table_key) as k from dbcat group by 1 having count(distinct table_key) = 1), bare as (select lower(table_name) as f, min(table_key) as k from dbcat group by 1 having count(distinct table_key) = 1)
 select query_id, mention, database_name, coalesce(a.k, b.k, c.k, d.k) as table_key, cast(case when a.k is not null then 0 when b.k is not null then 1 when c.k is not null then 2 when d.k is not null then 3 end as integer) as found_by from q
 left join (select distinct table_key as k from dbcat) a on len(p) = 3 and a.k = array_to_string(p, '.') left join (select distinct table_key as k from dbcat) b on len(p) >= 2 and database_name <> '' and b.k = database_name || '.' || array_to_string(p[-2:], '.')
 left join one c on len(p) >= 2 and c.f = array_to_string(p[-2:], '.') left join bare d on d.f = p[-1]""",
)
def database_name_resolution(spark, sf):
    h, t = relation(spark, sf, "history"), relation(spark, sf, "tables")
    copies = t.where("table_id % 2 = 0").withColumn("source_db", F.expr("'db' || cast((table_id + 1) % 3 as string)"))
    cat = t.unionByName(copies).withColumn("table_key", F.lower(F.concat_ws(".", "source_db", "schema_name", "table_name")))
    name = F.concat_ws(".", "schema_name", "table_name")
    form = F.when(F.expr("query_id % 5 = 0"), F.concat(F.expr("'db' || cast(query_id % 4 as string) || '.'"), name)).when(F.expr("query_id % 5 = 1"), F.upper(name)).when(F.expr("query_id % 5 = 2"), F.col("table_name")).when(F.expr("query_id % 5 = 3"), F.expr("""'"' || schema_name || '"."' || table_name || '"'""")).otherwise(F.concat(F.lit("nowhere."), "table_name"))
    said = h.join(t.hint("merge"), F.col("table_id") == F.expr("query_id % 1500 + 1")).select("query_id", F.when(F.expr("query_id % 7 = 0"), "").otherwise(F.col("database_name")).alias("database_name"), form.alias("mention"))
    return triage.resolved_by_database(said, cat).select("query_id", "mention", "database_name", "table_key", "found_by")
