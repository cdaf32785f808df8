"""Queries over captured step details."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import details, triage
from ..sources.adapter import relation, with_
from .core import near_sql, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


# Step details with every captured column; some lack a step, a level, a table or a measure, and steps repeat.
DETAILS = """select l_suppkey % 40 as user_id, l_orderkey as query_id, l_linenumber % 3 as child_query_sequence, case when l_partkey % 8 = 0 then 'Child Query' when l_partkey % 8 = 1 then null else 'step' end as metrics_level,
 case l_partkey % 5 when 0 then 'Scan' when 1 then 'hash join' when 2 then 'Sort' when 3 then 'aggregate' end as step_name, case when l_partkey % 6 <> 0 then l_linenumber % 2 end as step_id, case when l_suppkey % 4 = 0 then 'multi-dimensional' end as step_attribute, l_linenumber % 2 as stream_id, l_suppkey % 2 as segment_id,
 case when l_partkey % 7 <> 0 then l_linenumber end as plan_node_id, l_linenumber - 1 as plan_parent_id, case when l_partkey % 3 = 0 then l_partkey end as table_id, case when l_partkey % 3 = 0 then 't_' || cast(l_partkey % 4 as varchar(4)) end as table_name,
 case l_suppkey % 6 when 0 then 'S3' when 1 then 'internal' when 2 then 'local' when 3 then 'Spectrum' end as source, l_linenumber % 2 = 0 as is_rrscan, l_shipdate as start_time, l_shipdate as end_time, case when l_partkey % 10 <> 0 then cast(floor(l_extendedprice) as bigint) end as duration,
 cast(l_quantity as bigint) * 8192 as input_bytes, cast(l_quantity as bigint) * 1000000 as input_rows, cast(l_quantity as bigint) * 4096 as output_bytes, case when l_partkey % 9 <> 0 then cast(l_quantity as bigint) * 20000 end as output_rows, l_suppkey % 50 as blocks_read, l_suppkey % 20 as blocks_write,
 l_orderkey % 5 as local_read_io, l_suppkey % 4 as remote_read_io, case when l_suppkey % 11 = 0 then cast(l_quantity as bigint) * 400 else 0 end as spilled_block_local_disk, case when l_suppkey % 14 = 0 then cast(l_quantity as bigint) * 900 when l_suppkey % 14 < 9 then 0 end as spilled_block_remote_disk,
 l_partkey % 5 as data_skewness, l_suppkey % 4 as time_skewness, case when l_partkey % 13 = 0 then ' missing stats ' when l_partkey % 13 = 1 then ' ' end as alert from {lineitem}"""


def captured(spark, sf: str) -> DataFrame:
    return spark.sql(re.sub(r"\{(\w+)\}", rf"parquet.`{sf}/\1.parquet`", DETAILS))


_D = "d as (" + re.sub(r"[{}]", "", DETAILS) + ")"
_O = "lower(source) in ('s3', 'external', 'spectrum')"
_RATES = ["selectivity_ratio", "external_duration_pct", "remote_io_ratio", "external_selectivity", "avg_step_duration"]
_SUM = lambda c: f"cast(sum({c}) as bigint) as {c}"


@query(
    "details_rollup",
    f"""with {_D}, r as (select query_id, cast(sum(spilled_block_local_disk + spilled_block_remote_disk) as bigint) as total_spill, {', '.join(map(_SUM, ('input_bytes', 'output_bytes', 'blocks_read', 'blocks_write', 'local_read_io', 'remote_read_io', 'input_rows', 'output_rows')))},
 cast(sum(duration) as bigint) as total_step_duration, max(duration) as max_step_duration, avg(duration) as avg_step_duration, count(*) as total_steps, max(data_skewness) as max_data_skewness, max(time_skewness) as max_time_skewness, count(distinct segment_id) as segments_used, count(distinct stream_id) as streams_used,
 count(*) filter (step_name ilike '%scan%') as scan_steps, count(*) filter (step_name ilike '%join%') as join_steps, count(*) filter (step_name ilike '%sort%') as sort_steps, count(*) filter (step_name ilike '%agg%') as agg_steps, count(distinct table_id) as tables_touched, count(nullif(trim(alert), '')) as alert_count,
 count(*) filter ({_O}) as external_steps, count(*) filter (lower(source) = 's3') as s3_steps, cast(sum(input_bytes) filter ({_O}) as bigint) as external_input_bytes, cast(sum(input_rows) filter ({_O}) as bigint) as external_input_rows, sum(output_rows) filter ({_O}) as eo, cast(sum(duration) filter ({_O}) as bigint) as external_duration,
 cast(sum(spilled_block_remote_disk) filter ({_O}) as bigint) as external_spill_blocks, count(distinct table_name) filter ({_O}) as external_tables_touched, max(data_skewness) filter ({_O}) as external_data_skew, sum(local_read_io + remote_read_io) as reads from d group by query_id),
 x as (select *, case when input_rows > 0 then output_rows / cast(input_rows as double) end as selectivity_ratio, case when total_step_duration > 0 then external_duration / cast(total_step_duration as double) end as external_duration_pct, case when reads > 0 then remote_read_io / cast(reads as double) end as remote_io_ratio, case when external_input_rows > 0 then eo / cast(external_input_rows as double) end as external_selectivity from r)
 select * exclude (reads, eo, {', '.join(_RATES)}), {', '.join(f'{near_sql(c)} as {c}' for c in _RATES)} from x""",
)
def details_rollup(spark, sf):
    return rounded(details.details_rollup(captured(spark, sf)), *_RATES)


_G = ", ".join(details.FLOW_KEYS)
_REST = ", ".join(f"{c} nulls first" for c in details.FLOW_KEYS if c != "query_id")
_PAINS = "[('ALERT', alert_count > 0), ('REMOTE_SPILL', spilled_block_remote_disk > 0), ('LOCAL_SPILL', spilled_block_local_disk > 0), ('DATA_SKEW', data_skewness >= 3), ('TIME_SKEW', time_skewness >= 3), ('REMOTE_IO', remote_read_io > local_read_io), ('EXTERNAL_SOURCE', lower(coalesce(source, 'internal')) <> 'internal'), ('LARGE_JOIN', coalesce(step_name ilike '%join%', false) and input_rows >= 10000000), ('LARGE_SCAN', coalesce(step_name ilike '%scan%', false) and input_rows >= 10000000)]"


@query(
    "grouped_flow",
    f"""with {_D}, g as (select {_G}, min(start_time) as start_time, max(end_time) as end_time, {', '.join(f'cast(sum(coalesce({c}, 0)) as bigint) as {c}' for c in details._FLOW_SUMS)}, max(coalesce(duration, 0)) as max_duration, count(*) as detail_row_count, max(data_skewness) as data_skewness, max(time_skewness) as time_skewness, max(nullif(trim(alert), '')) as alert, count(nullif(trim(alert), '')) as alert_count
 from d where lower(coalesce(metrics_level, '')) in ('step', 'child query') or step_id is not null or plan_node_id is not null group by {_G}),
 s as (select *, least(spilled_block_remote_disk / 1000.0, 25) + least(spilled_block_local_disk / 1000.0, 15) + case when alert_count > 0 then 20 else 0 end + case when data_skewness >= 3 then 15 when data_skewness >= 2 then 8 else 0 end + case when time_skewness >= 3 then 15 when time_skewness >= 2 then 8 else 0 end + case when remote_read_io > local_read_io then 10 else 0 end
  + case when lower(coalesce(source, 'internal')) <> 'internal' then 8 else 0 end + case when step_name ilike '%join%' and input_rows >= 10000000 then 8 else 0 end + case when step_name ilike '%scan%' and input_rows >= 10000000 then 6 else 0 end as pain_score, list_transform(list_filter({_PAINS}, lambda p: p[2]), lambda p: p[1]) as held from g),
 r as (select *, row_number() over (partition by query_id order by coalesce(child_query_sequence, 0), coalesce(stream_id, 0), coalesce(segment_id, 0), coalesce(step_id, 0), coalesce(plan_node_id, 0), coalesce(start_time, end_time) nulls last, {_REST}) as detail_row_rank, row_number() over (partition by query_id order by round(pain_score, 6) desc, duration desc, input_rows desc, {_REST}) as pain_rank from s)
 select {_G}, duration, max_duration, detail_row_count, input_rows, output_rows, blocks_read, alert, coalesce(held[1], 'NORMAL') as dominant_pain, array_to_string(list_transform(held, lambda x: x || ';'), '') as pain_points, {near_sql('pain_score', 4)} as pain_score, cast(detail_row_rank as integer) as detail_row_rank, cast(pain_rank as integer) as pain_rank from r where detail_row_rank <= 300""",
)
def grouped_flow(spark, sf):
    found = details.grouped_flow(captured(spark, sf))
    return rounded(found, "pain_score", digits=4).select(*details.FLOW_KEYS, "duration", "max_duration", "detail_row_count", "input_rows", "output_rows", "blocks_read", "alert", "dominant_pain", "pain_points", "pain_score", "detail_row_rank", "pain_rank")


# Steps that name their table: a third by number, a third by schema and name, the rest by a bare name or one that no table has
_NAMED = """named as (select s.query_id, s.step_id, case when s.query_id % 3 = 0 then s.table_id end as table_id, case when s.query_id % 3 = 1 then upper(t.schema_name) when s.query_id % 3 = 2 then 'other' end as schema_name, case when s.query_id % 30 = 2 then 'none_' else '' end || t.table_name as table_name from steps s join tables t on t.table_id = s.table_id)"""


@query(
    "steps_by_name",
    f"""{with_("steps", "tables")}, {_NAMED}, f as (select lower(schema_name || '.' || table_name) as form, min(table_id) as id from tables group by 1), b as (select lower(table_name) as form, min(table_id) as id from tables group by 1)
 select n.query_id, n.step_id, coalesce(n.table_id, f.id, b.id) as table_id, count(*) as n from named n left join f on n.table_id is null and f.form = lower(n.schema_name || '.' || n.table_name) left join b on n.table_id is null and b.form = lower(n.table_name) group by all""",
)
def steps_by_name(spark, sf):
    s, t = relation(spark, sf, "steps"), relation(spark, sf, "tables")
    names = t.select(F.col("table_id").alias("_t"), F.col("schema_name").alias("_s"), F.col("table_name").alias("_n"))
    named = s.join(names, F.col("table_id") == F.col("_t")).select(
        "query_id", "step_id", F.when(F.expr("query_id % 3 = 0"), F.col("table_id")).alias("table_id"), F.when(F.expr("query_id % 3 = 1"), F.upper("_s")).when(F.expr("query_id % 3 = 2"), "other").alias("schema_name"),
        F.concat(F.when(F.expr("query_id % 30 = 2"), "none_").otherwise(""), F.col("_n")).alias("table_name"),
    )
    return triage.located(named, t).groupBy("query_id", "step_id", "table_id").agg(F.count("*").alias("n"))
