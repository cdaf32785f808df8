"""Queries over external-table facts assembled from staged frames."""

from __future__ import annotations

import re


from ..operators import assembly
from .core import near_sql, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# The staged frames, projected from the tables: names of three forms, none at all, and places under the locations or beside them.
STAGED = {
    "svv_external_tables": """select ' Db' || cast(s_suppkey % 3 as varchar(4)) as "Redshift_Database_Name", 'Spectrum_' || cast(s_suppkey % 4 as varchar(4)) as schemaname, 'Ext_' || cast(s_suppkey % 50 as varchar(9)) as tablename, case s_suppkey % 5 when 0 then 'VIEW' when 1 then null else 'TABLE' end as tabletype,
 's3://Lake/' || cast(s_suppkey % 7 as varchar(4)) || case when s_suppkey % 2 = 0 then '/t' || cast(s_suppkey as varchar(9)) || '/' else '' end as location, case when s_suppkey % 2 = 0 then 'Parquet' else 'Text' end as input_format, cast(s_suppkey % 2 as varchar(2)) as compressed, 'p' as parameters from {supplier} where s_suppkey <= 600 or s_suppkey % 5 = 2""",
    "external_column_stats": """select 'db' || cast(p_partkey % 3 as varchar(4)) || '.spectrum_' || cast(p_partkey % 4 as varchar(4)) || '.ext_' || cast(p_partkey % 50 as varchar(9)) as external_table_key, 'c' || cast(p_partkey as varchar(12)) as columnname, case when p_size <= 3 then p_size end as part_key from {part}""",
    "sys_query_history": """select o_orderkey as query_id, 'DB' || cast(o_orderkey % 3 as varchar(4)) || ' ' as database_name from {orders}""",
    "sys_external_query_detail": """select l_suppkey % 90 as user_id, l_orderkey as query_id, l_linenumber % 2 as child_query_sequence, l_linenumber as segment_id, case when l_partkey % 9 = 0 then 'HDFS' else 'S3' end as source_type, l_shipdate as start_time, l_shipdate as end_time, cast(floor(l_extendedprice) as bigint) as duration,
 l_partkey % 40 as total_partitions, l_partkey % 20 as qualified_partitions, l_suppkey % 300 as scanned_files, cast(l_quantity as bigint) * 1000 as returned_rows, cast(l_quantity as bigint) * 900000 as returned_bytes, l_returnflag as file_format,
 's3://lake/' || cast(l_suppkey % 7 as varchar(4)) || '/t' || cast(l_suppkey as varchar(9)) || '/f' || cast(l_linenumber as varchar(4)) as file_location,
 case l_partkey % 12 when 0 then 'Access Denied for role' when 1 then 'no partition filter' when 2 then 'bad SerDe' when 3 then 'path gone' when 4 then 'Retry later' when 5 then 'unclear' when 6 then ' ' end as warning_message,
 case l_partkey % 4 when 0 then 'db' || cast(l_orderkey % 3 as varchar(4)) || '.spectrum_' || cast(l_suppkey % 4 as varchar(4)) || '.ext_' || cast(l_suppkey % 50 as varchar(9)) when 1 then 'SPECTRUM_' || cast(l_suppkey % 4 as varchar(4)) || '.ext_' || cast(l_suppkey % 50 as varchar(9)) when 2 then 'ext_' || cast(l_suppkey % 50 as varchar(9)) end as table_name,
 case when l_partkey % 6 = 0 then 'T' else 'f' end as is_recursive, 'no' as is_nested, l_linenumber * 10 as s3list_time, l_linenumber as get_partition_time from {lineitem}""",
    "sys_query_detail": """select l_orderkey as query_id, l_linenumber as segment_id, case when l_suppkey % 2 = 0 then 'Ext_' || cast(l_suppkey % 50 as varchar(9)) else 'x.ext_' || cast(l_suppkey % 50 as varchar(9)) end as table_name, cast(l_quantity as bigint) * 50000 as output_bytes, cast(l_quantity as bigint) * (l_suppkey % 9) * 100 as output_rows, l_suppkey % 6 as data_skewness, l_suppkey % 5 as time_skewness,
 l_suppkey % 4 as spilled_block_local_disk, case when l_suppkey % 3 = 0 then l_suppkey % 2 end as spilled_block_remote_disk, l_linenumber - 2 as step_id, case when l_suppkey % 8 = 0 then 'join' else 'Scan' end as step_name, case l_suppkey % 4 when 0 then 's3' when 1 then 'Spectrum' when 2 then 'local' else 'external' end as source from {lineitem}""",
    "sys_external_query_error": """select l_orderkey as query_id, 's3://lake/' || cast(l_suppkey % 7 as varchar(4)) || '/t' || cast(l_suppkey as varchar(9)) || '/f' as file_location, cast(l_linenumber as varchar(4)) as rowid, 'c' || cast(l_suppkey % 6 as varchar(4)) as column_name, case l_suppkey % 5 when 0 then 'Truncated' when 1 then 'x' end as trigger, case l_suppkey % 4 when 0 then 'set NULL' when 1 then 'Overflow' when 2 then 'invalid value' end as action, l_partkey % 11 as error_code from {lineitem} where l_suppkey % 3 = 0""",
}


def stages(spark, sf: str) -> dict:
    path = lambda m: f"parquet.`{sf}/{m[1]}.parquet`"
    return {name: spark.sql(re.sub(r"\{(\w+)\}", path, text.replace('"', "`"))) for name, text in STAGED.items()}


_FIRST = "row_number() over (partition by {by} order by {order}) = 1"
_WORDS = lambda c, words: " ".join(f"when regexp_matches({c}, '(?i){'|'.join(w)}') then '{k}'" for k, w in words.items())


def _sql(without: tuple[str, ...] = ()) -> str:
    raw = ", ".join(f"{name}_ as ({re.sub(r'[{}]', '', text)}{' limit 0' if name in without else ''})" for name, text in STAGED.items())
    warning = f"case when coalesce(trim(warning_message), '') = '' then null {_WORDS('warning_message', assembly.WARNING_WORDS)} else 'other' end"
    words = "concat_ws(' ', action, trigger)"
    seg_key = "query_id, child_query_sequence, segment_id, name, place"
    counts = ", ".join(f"count(*) filter (w = '{k}') as {k}_warning_count" for k in (*assembly.WARNING_WORDS, "other"))
    kinds = ", ".join(f"count(*) filter (kind = '{k}') as {k}_error_count" for k in (*assembly.ERROR_WORDS, "other"))
    return f"""with {raw}, cat as (select lower(trim("Redshift_Database_Name") || '.' || trim(schemaname) || '.' || trim(tablename)) as k, lower(trim("Redshift_Database_Name")) as db, lower(schemaname || '.' || tablename) as st, lower(tablename) as t, lower(trim(location)) as loc from svv_external_tables_ where lower(trim(coalesce(tabletype, 'TABLE'))) in ('table', '')),
 h as (select query_id, lower(trim(database_name)) as db from sys_query_history_),
 seg as (select d.*, h.db, coalesce(lower(trim(table_name)), '') as name, coalesce(lower(trim(file_location)), '') as place from sys_external_query_detail_ d join h using (query_id) where lower(source_type) = 's3'),
 one as (select * from seg qualify {_FIRST.format(by=seg_key, order="start_time, end_time, duration, returned_rows, returned_bytes")}),
 m as (select one.*, cat.k from one join cat on cat.db = one.db and (name in (k, st, t) or (place <> '' and loc <> '' and starts_with(place, loc)))
  qualify {_FIRST.format(by=seg_key, order="case when name = k then 1 when name = st then 2 when name = t then 3 else 4 end, length(loc) desc, k")}),
 so as (select query_id, segment_id, lower(trim(table_name)) as dt, sum(output_bytes) as output_bytes, sum(output_rows) as output_rows, max(data_skewness) as data_skewness, sum(spilled_block_local_disk + spilled_block_remote_disk) as spill_blocks from sys_query_detail_ where step_id >= 0 and lower(step_name) = 'scan' and lower(source) in ('s3', 'external', 'spectrum') group by all),
 mo as (select m.*, so.output_bytes, so.output_rows, so.data_skewness, so.spill_blocks from m left join so on so.query_id = m.query_id and so.segment_id = m.segment_id and (dt = name or ends_with(dt, '.' || name) or ends_with(name, '.' || dt))
  qualify {_FIRST.format(by=', '.join('m.' + c for c in seg_key.split(', ')), order="case when dt = name then 0 else 1 end, dt")}),
 a as (select k, count(distinct query_id) as query_count, count(*) as external_segment_count, count(distinct user_id) as user_count, sum(returned_bytes) as gross_scan_bytes, sum(returned_rows) as gross_scan_rows, sum(output_rows) as gross_output_rows, count(output_bytes) as output_metric_match_count, sum(total_partitions) as tp, sum(qualified_partitions) as qp,
  count(*) filter (total_partitions > qualified_partitions) as pruning_event_count, sum(duration) as du, sum(spill_blocks) as external_spill_blocks, max(data_skewness) as max_data_skewness, count(*) filter (is_recursive = 'T') as recursive_scan_count, count(w) as warning_event_count, {counts}, max(case when w is not null then warning_message end) as warning_example from (select *, {warning} as w from mo) group by k),
 e0 as (select query_id, file_location, rowid, column_name, error_code, min(case when {words} = '' then 'other' {_WORDS(words, assembly.ERROR_WORDS)} else 'other' end) as kind from sys_external_query_error_ group by all),
 e1 as (select e0.*, cat.k from e0 join h using (query_id) join cat on cat.db = h.db and loc <> '' and starts_with(lower(file_location), loc) qualify {_FIRST.format(by="query_id, file_location, rowid, column_name, error_code", order="length(loc) desc, k")}),
 e as (select k, count(*) as sampled_error_count, count(distinct error_code) as distinct_error_code_count, {kinds} from e1 group by k),
 c as (select external_table_key as k, count(*) as column_count, count(*) filter (part_key > 0) as partition_key_count, string_agg(columnname, ', ' order by part_key, columnname) filter (part_key > 0) as keys from external_column_stats_ group by 1),
 x as (select cat.k as external_table_key, coalesce(column_count, 0) as column_count, coalesce(keys, '') as partition_key_columns, {', '.join(f'cast(coalesce({n}, 0) as bigint) as {n}' for n in _NUMBERS)}, cast(gross_output_rows as bigint) as gross_output_rows, warning_example, cast(max_data_skewness as bigint) as max_data_skewness,
  case when tp > 0 then 100.0 * (1 - cast(qp as double) / tp) end as partition_pruning_pct, case when gross_scan_rows > 0 then 100 * (1 - least(cast(gross_output_rows as double) / gross_scan_rows, 1)) end as rf, coalesce(du, 0) / 1e6 as external_duration_s from cat left join c using (k) left join a using (k) left join e using (k))
 select * exclude (partition_pruning_pct, rf, external_duration_s), {near_sql('partition_pruning_pct', 3)} as partition_pruning_pct, {near_sql('rf', 3)} as row_filter_efficiency_pct, {near_sql('external_duration_s', 3)} as external_duration_s,
  case when query_count = 0 then 'NO_ACTIVITY' when gross_output_rows is null then 'OUTPUT_UNAVAILABLE' when rf >= 90 then 'HIGHLY_SELECTIVE' when rf >= 50 then 'SELECTIVE' when rf >= 10 then 'LIGHT_FILTERING' else 'LOW_FILTERING' end as filtering_assessment from x"""


_NUMBERS = ["query_count", "external_segment_count", "user_count", "gross_scan_bytes", "gross_scan_rows", "output_metric_match_count", "pruning_event_count", "external_spill_blocks", "recursive_scan_count", "warning_event_count", *(f"{k}_warning_count" for k in (*assembly.WARNING_WORDS, "other")), "sampled_error_count", "distinct_error_code_count", *(f"{k}_error_count" for k in (*assembly.ERROR_WORDS, "other"))]
_TEXTS = ["external_table_key", "column_count", "partition_key_columns", "gross_output_rows", "warning_example", "max_data_skewness", "filtering_assessment"]
_RATES = ["partition_pruning_pct", "row_filter_efficiency_pct", "external_duration_s"]


def _shown(df):
    return rounded(df.select(*_TEXTS, *_NUMBERS, *_RATES), *_RATES, digits=3)


ORACLES["external_assembly"] = _sql()
QUERIES["external_assembly"] = lambda spark, sf: _shown(assembly.assembled(spark, stages(spark, sf)))
_MISSING = ("sys_query_detail", "sys_external_query_error")
ORACLES["external_assembly_partial"] = _sql(_MISSING)


def external_assembly_partial(spark, sf):
    return _shown(assembly.assembled(spark, {k: v for k, v in stages(spark, sf).items() if k not in _MISSING}))


QUERIES["external_assembly_partial"] = external_assembly_partial
