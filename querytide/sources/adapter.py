"""Telemetry relations projected from the driver's tables, in SQL that Spark and DuckDB both run.

`{lineitem}` and the like stand for a table: a view's name in the oracle, a parquet path in Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RELATIONS = {
    "steps": """select l_orderkey as query_id, l_linenumber as step_id, l_linenumber%2 as stream_id, l_linenumber%3 as segment_id,
 case l_returnflag when 'A' then 'scan' when 'N' then (case when l_linestatus='O' then 'hash join' else 'aggregate' end) else (case when l_linestatus='O' then 'sort' else 'scan' end) end as step_name,
 l_partkey as table_id, case when l_suppkey%7=0 then 's3' when l_returnflag='A' then 'local' end as source,
 cast(l_quantity as bigint)*1000000 as input_rows, cast(l_quantity as bigint)*(l_partkey%50)*20000*(case when l_returnflag='R' and l_linestatus='O' then 20 else 1 end) as output_rows,
 cast(l_quantity as bigint)*8192 as input_bytes, case when l_suppkey%11=0 then cast(l_quantity as bigint)*4000 else 0 end as spill_local, case when l_suppkey%14=0 then cast(l_quantity as bigint)*1000 else 0 end as spill_remote,
 (l_partkey%9) as data_skewness, (l_suppkey%10) as time_skewness, l_orderkey%5 as local_read_io, l_suppkey%4 as remote_read_io, cast(round(l_extendedprice*100) as bigint)*100 as duration,
 case when l_partkey%13=0 then 'missing_stats' end as alert from {lineitem}""",
    "tables": """select p_partkey as table_id, 'db'||cast(p_partkey%3 as varchar(20)) as source_db, lower(replace(p_brand,'#','_')) as schema_name, replace(p_name,' ','_')||'_'||cast(p_partkey as varchar(20)) as table_name,
 case p_size%4 when 0 then 'EVEN' when 1 then 'ALL' when 2 then 'KEY(cust_id)' else 'AUTO(EVEN)' end as diststyle, case p_size%5 when 0 then '' when 1 then 'AUTO(SORTKEY)' when 2 then 'None' when 3 then 'event_date' else 'cust_id' end as sortkey1,
 p_size*(p_partkey%100) as size_mb, cast(p_size as bigint)*10000000 as tbl_rows, p_size*2 as unsorted_pct, p_size%30 as stats_off, p_partkey%7 as skew_rows, p_partkey%25 as vacuum_sort_benefit from {part}""",
    "plans": """select l_orderkey as query_id, l_linenumber as plan_node_id,
 case l_partkey%10 when 0 then 'XN Hash Join DS_DIST_BOTH' when 1 then 'XN Hash Join DS_BCAST_INNER' when 3 then 'XN S3 Seq Scan on ext' when 4 then 'XN Nested Loop DS_DIST_NONE' when 5 then 'XN Network' when 6 then 'XN Partition Loop' when 7 then 'XN Sort' else 'XN Seq Scan on t' end
 || '  (cost=0.00..' || cast(l_partkey*10 as varchar(20)) || '.50 rows=' || cast(l_suppkey*1000 as varchar(20)) || ' width=8)' as plan_node,
 case l_suppkey%6 when 0 then 'Filter: (x = 1)' when 1 then 'missing statistics' else '' end as plan_info from {lineitem}""",
    "statements": """select o.o_orderkey as query_id, case o.o_orderkey%8
 when 0 then 'SELECT * FROM db.' || s || '.' || t || ' WHERE event_date = ''2024-01-0' || cast(o.o_orderkey%9+1 as varchar(4)) || ''''
 when 1 then 'select a, b from ' || s || '.' || t || ' where name like ''%x' || cast(o.o_orderkey as varchar(12)) || ''''
 when 2 then 'SELECT a FROM ' || t || ' UNION SELECT b FROM other_table WHERE id IN (' || cast(o.o_orderkey as varchar(12)) || ', 2, 3)'
 when 3 then 'SELECT x.a FROM ' || t || ' x CROSS JOIN dim_store d'
 when 4 then 'SELECT a, sum(v) FROM stg_load_' || cast(100000+o.o_orderkey as varchar(12)) || ' GROUP BY a ORDER BY 2 DESC'
 when 5 then 'CALL etl.load_' || cast(o.o_orderkey%4 as varchar(4)) || '(' || cast(o.o_orderkey as varchar(12)) || ')'
 when 6 then 'UNLOAD (''select a from ' || t || ' where d = ''''2024-01-01'''' '') TO ''s3://b/' || cast(o.o_orderkey as varchar(12)) || ''''
 else '/* run ' || cast(o.o_orderkey as varchar(12)) || ' */ select c from ' || s || '.' || t || ' where v > ' || cast(o.o_orderkey%100 as varchar(4)) || ' limit ' || cast(o.o_orderkey%7+1 as varchar(4)) end as sql_text
 from {orders} o join (select p_partkey, lower(replace(p_brand,'#','_')) as s, replace(p_name,' ','_') || '_' || cast(p_partkey as varchar(12)) as t from {part}) p on p.p_partkey = o.o_orderkey%200 + 1""",
    "history": """select o_orderkey as query_id, o_custkey%150 as user_id, 'db' || cast(o_custkey%3 as varchar(20)) as database_name, case when o_custkey%4=0 then cast(o_custkey as varchar(20)) when o_custkey%4=1 then '' else 'user_' || cast(o_custkey%150 as varchar(20)) end as user_name,
 case o_orderkey%10 when 0 then 'PROCEDURE' when 1 then 'UTILITY' when 2 then 'DDL' else 'SELECT' end as query_type, case o_orderstatus when 'F' then 'success' when 'O' then 'success' else 'failed' end as status, o_orderkey%17=0 as result_cache_hit,
 o_orderdate as start_time, case when o_orderkey%6=0 then null else o_orderdate + (o_orderkey%7200) * interval '1' second end as end_time,
 cast(round(o_totalprice*100) as bigint)*1000 as elapsed_time, cast(round(o_totalprice*100) as bigint)*800 as execution_time, (o_orderkey%97)*1000000 as queue_time, 'ns' || cast(o_custkey%5 as varchar(20)) as namespace_id from {orders}""",
    "history_all": """select o_orderkey as query_id, 'ns' || cast(o_custkey%5 as varchar(20)) as namespace_id, cast(round(o_totalprice*100) as bigint)*1000 as elapsed_time, 'orders' as origin from {orders}
 union all select event_id + 1000000000 as query_id, 'ns' || cast(user_id%5 as varchar(20)) as namespace_id, cast(round(value*100) as bigint)*1000 as elapsed_time, 'events' as origin from {events}""",
    "patterns": """select 'P' || cast(p_partkey as varchar(20)) as repeat_group_id, case when p_partkey%11=0 then 'proc' else 'sql' end as repeat_kind, case p_partkey%5 when 0 then 'UTILITY' when 1 then 'DDL' else 'SELECT' end as query_type, p_size as query_count, cast(p_size*(p_partkey%90)*100 as double) as total_runtime_s,
 lower(replace(p_brand,'#','_')) || '.' || replace(p_name,' ','_') || '_' || cast(p_partkey as varchar(20)) || case when p_partkey%4=0 then ', other.unknown' else '' end as sql_tables, case p_partkey%3 when 0 then 'event_date, a.cust_id' when 1 then 'cust_id' else 'event_date' end as sql_filter_columns, case p_partkey%2 when 0 then 'cust_id; b.item_id' else '' end as sql_join_columns,
 p_partkey%3 as wildcard_count, p_partkey%4 as predicate_count, p_partkey%5 as join_count, cast(p_partkey%6*1000 as double) as avg_total_spill, cast(p_partkey%10 as double)/10 as avg_has_nested_loop, cast(p_partkey%7 as double)/7 as avg_dist_both_cnt, cast(p_partkey%9 as double)/9 as avg_bcast_cnt, cast(p_partkey%8 as double)/8 as avg_remote_io_ratio,
 cast(p_partkey%9 as double) as avg_max_data_skewness, cast(p_partkey%6 as double) as avg_max_time_skewness, cast(p_partkey%12 as double)/10 as avg_selectivity_ratio, cast(p_partkey%4 as double) as avg_s3_scan_cnt, cast(p_size as bigint)*1000000 as total_input_rows, cast(p_partkey%50 as double) as total_queue_s from {part}""",
    "fragments": """select conv_id as query_id, turn as sequence, text from {conversations}""",
    "users": """select c_custkey%150 as user_id, 'ns' || cast(c_custkey%5 as varchar(20)) as namespace_id, 'IAM:' || lower(c_mktsegment) || '.' || cast(c_custkey%150 as varchar(12)) || '.smith@corp.example' as user_name from {customer}""",
    "scans": """select l_orderkey as query_id, 'DB' || cast(l_partkey%3 as varchar(20)) || '.' || lower(replace(p_brand,'#','_')) || '.' || replace(p_name,' ','_') || '_' || cast(p_partkey as varchar(20)) as full_table_name,
 cast(l_quantity as bigint)*1000000 as input_rows, cast(round(l_extendedprice*100) as bigint)*100 as duration, l_linenumber%2=0 as is_rrscan from {lineitem} join {part} on p_partkey=l_partkey""",
    "externals": """select s_suppkey as ext_id, 'spectrum_' || cast(s_suppkey%4 as varchar(20)) as schema_name, 'ext_' || cast(s_suppkey as varchar(20)) as table_name, 's3://lake/' || cast(s_suppkey%10 as varchar(20)) || '/ext_' || cast(s_suppkey as varchar(20)) || '/' as location,
 case s_suppkey%3 when 0 then 'TextInputFormat' when 1 then 'MapredParquetInputFormat' else 'OrcInputFormat' end as input_format, case when s_suppkey%4=0 then 'numRows=1000' else '' end as parameters, cast(s_suppkey%3 as bigint) as partition_keys from {supplier}""",
    "segments": """select l_orderkey as query_id, l_linenumber as segment_id, case l_suppkey%3 when 0 then 'ext_' || cast(l_suppkey as varchar(20)) when 1 then 'spectrum_' || cast(l_suppkey%4 as varchar(20)) || '.ext_' || cast(l_suppkey as varchar(20)) else '' end as table_name,
 's3://lake/' || cast(l_suppkey%10 as varchar(20)) || '/ext_' || cast(l_suppkey as varchar(20)) || '/part-' || cast(l_linenumber as varchar(20)) as file_location, cast(l_quantity as bigint) as total_partitions, cast(l_quantity as bigint) % 7 as qualified_partitions,
 cast(l_quantity as bigint)*10 as scanned_files, cast(l_quantity as bigint)*1000 as returned_rows, cast(l_quantity as bigint)*1000000000 as returned_bytes, cast(round(l_extendedprice*100) as bigint)*10 as duration, l_linenumber*100 as s3list_time,
 case when l_partkey%11=0 then 'Partition pruning failed' when l_partkey%13=0 then 'Too many small files' end as warning from {lineitem}""",
}


def oracle(name: str) -> str:
    """The relation's text for the oracle's views."""
    return re.sub(r"\{(\w+)\}", r"\1", RELATIONS[name])


def with_(*names: str) -> str:
    """A WITH prefix that defines the relations."""
    return "with " + ", ".join(f"{n} as ({oracle(n)})" for n in names)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", RELATIONS[name]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
