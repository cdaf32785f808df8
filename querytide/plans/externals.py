"""Queries over external tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import external, grouping
from ..sources.adapter import relation, with_
from .core import _r, near_sql, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


_WITH = with_("segments", "externals")
MATCH = r"""seg as (select distinct query_id, segment_id, table_name, file_location from segments),
cand as (select seg.*, ext_id, case when lower(seg.table_name) = schema_name || '.' || e.table_name then 1 when string_split(lower(seg.table_name), '.')[-1] = e.table_name then 2 when starts_with(file_location, location) then 3 end as cls, length(location) as len
 from seg join externals e on string_split(lower(seg.table_name), '.')[-1] = e.table_name or starts_with(file_location, location)),
best as (select * from cand qualify row_number() over (partition by query_id, segment_id, table_name, file_location order by cls, case when cls = 3 then -len else 0 end, ext_id) = 1),
mat as (select s.*, b.ext_id, b.cls from segments s left join best b on b.query_id = s.query_id and b.segment_id = s.segment_id and b.table_name = s.table_name and b.file_location = s.file_location)"""
_CAT = "case when warning is null or trim(warning) = '' then null when warning ilike '%partition%' then 'PARTITION' when warning ilike '%small file%' then 'SMALL_FILES' when warning ilike '%denied%' then 'ACCESS' when warning ilike '%format%' then 'FORMAT' else 'OTHER' end"
ACT = f"""act as (select ext_id, count(distinct query_id) as query_count, count(*) as segment_count, cast(sum(total_partitions) as bigint) as total_partitions, cast(sum(qualified_partitions) as bigint) as qualified_partitions, cast(sum(scanned_files) as bigint) as scanned_files, cast(sum(returned_rows) as bigint) as returned_rows,
 sum(returned_bytes) / 1e9 as scan_gb, sum(duration) / 1e6 as external_duration_s, max(s3list_time) as s3list_time_ms, count(*) filter ({_CAT} is not null) as warning_count, count(*) filter ({_CAT} = 'PARTITION') as partition_warnings from mat where ext_id is not null group by ext_id)"""
EXT = """ext as (select e.*, schema_name || '.' || table_name as external_table_key, a.* exclude (ext_id), case when total_partitions > 0 then 100.0 * (total_partitions - qualified_partitions) / cast(total_partitions as double) end as partition_pruning_pct,
 scanned_files / cast(segment_count as double) as avg_files_per_segment, scanned_files / cast(query_count as double) as files_per_query from externals e left join act a using (ext_id))"""
_BAND = "case when partition_pruning_pct is null then 'unknown' when partition_pruning_pct >= 90 then 'excellent' when partition_pruning_pct >= 50 then 'partial' when partition_pruning_pct >= 10 then 'weak' else 'none' end as pruning_band"
_CHAIN = f"{_WITH}, {MATCH}, {ACT}, {EXT}"
# steps of the segments: half of them name the table barely, a third put out fewer rows, some spill
_STEPS = "stp as (select query_id, segment_id, case when query_id % 2 = 0 then string_split(table_name, '.')[-1] else 'x.' || table_name end as step_table, returned_rows // (segment_id * 4) as output_rows, query_id % 50 as spill_blocks from segments where table_name <> '' and query_id % 3 <> 0)"
OUT = f"""{_STEPS}, so as (select m.*, stp.output_rows, stp.spill_blocks from mat m left join stp on m.query_id = stp.query_id and m.segment_id = stp.segment_id and m.table_name <> '' and (lower(m.table_name) = lower(step_table) or ends_with(lower(m.table_name), '.' || lower(step_table)) or ends_with(lower(step_table), '.' || lower(m.table_name)))),
outs as (select ext_id, count(output_rows) as output_metric_match_count, cast(sum(coalesce(spill_blocks, 0)) as bigint) as external_spill_blocks, case when sum(returned_rows) filter (output_rows is not null) > 0 then greatest(0, 100.0 * (sum(returned_rows) filter (output_rows is not null) - sum(output_rows)) / cast(sum(returned_rows) filter (output_rows is not null) as double)) end as row_filter_efficiency_pct from so where ext_id is not null group by ext_id),
er as (select query_id * 10 + segment_id as error_id, min(file_location) as file_location, min(query_id % 5) as error_code from segments where warning is not null group by 1), errs as (select ext_id, count(*) as error_count, count(distinct error_code) as error_codes from (select error_id, error_code, ext_id from er join externals on starts_with(file_location, location) qualify row_number() over (partition by error_id order by length(location) desc, ext_id) = 1) group by ext_id),
cols as (select 'spectrum_' || cast(s_suppkey % 4 as varchar(20)) || '.ext_' || cast(s_suppkey as varchar(20)) as external_table_key, cast(s_suppkey % 9 + 1 as bigint) as column_count from supplier),
full_ as (select ext.*, column_count, outs.* exclude (ext_id), errs.* exclude (ext_id) from ext left join cols using (external_table_key) left join outs using (ext_id) left join errs using (ext_id)),
fa as (select *, coalesce(partition_pruning_pct, -1) as pr, coalesce(total_partitions, 0) > 1 as many, partition_keys > 0 as keyed, s3list_time_ms / cast(greatest(query_count, 1) as double) as li, coalesce(output_metric_match_count, 0) > 0 as ms, coalesce(row_filter_efficiency_pct, 0) as rf, case when scan_gb >= 10 then 30 else 20 end as hv from full_ where query_count > 0 and scan_gb > 0)"""
ISSUES = """iss as (
 select ext_id, 'COLUMNAR_FORMAT' as code, 30 as weight, 'Convert' as t from fa where not regexp_matches(upper(input_format), 'PARQUET|ORC|RCFILE')
 union all select ext_id, case when many and pr < 50 and keyed then 'PARTITION_PREDICATE' when many and pr < 50 then 'PARTITION_DESIGN' when many then 'PARTITION_PREDICATE' else 'PARTITION_DESIGN' end, case when many and pr < 50 then hv when many then 15 else 20 end, case when many and pr < 50 and keyed then 'Make' when many and pr < 50 then 'Redesign' when many then 'Tighten' else 'Evaluate' end from fa where (many and (pr < 50 or (pr < 90 and scan_gb >= 10))) or (not many and not keyed and scan_gb >= 25)
 union all select ext_id, 'FILE_LAYOUT', case when avg_files_per_segment > 1000 or files_per_query > 5000 or li > 2000 then 25 else 15 end, case when avg_files_per_segment > 1000 or files_per_query > 5000 or li > 2000 then 'Compact' else 'Review S3' end from fa where avg_files_per_segment > 100 or files_per_query > 5000 or li > 500
 union all select ext_id, 'PUSHDOWN', case when rf >= 90 and scan_gb >= 25 then 20 else 12 end, case when rf >= 90 and scan_gb >= 25 then 'Push' else 'Review predicate' end from fa where ms and ((rf >= 90 and scan_gb >= 25) or (rf >= 50 and scan_gb >= 100))
 union all select ext_id, 'MATERIALIZE_OR_STAGE', case when query_count >= 25 or scan_gb >= 500 then 25 else 18 end, 'Materialize' from fa where query_count >= 10 and (scan_gb >= 100 or external_duration_s >= 3600)
 union all select ext_id, 'EXTERNAL_STATISTICS', 12, 'Verify' from fa where not contains(parameters, 'numRows') and query_count >= 5 and scan_gb >= 10
 union all select ext_id, 'DATA_QUALITY', case when error_count > 0 then 20 else 12 end, 'Resolve' from fa where warning_count > 5 or error_count > 0
 union all select ext_id, 'LOCAL_STAGE_DESIGN', 12, 'Review a' from fa where external_spill_blocks > 0 and query_count >= 5),
sc as (select ext_id, cast(least(sum(weight), 100) as integer) as score, string_agg(code, ',' order by weight desc, t) as codes from iss group by ext_id)"""


def matched(spark, sf) -> DataFrame:
    return external.matched(relation(spark, sf, "segments"), relation(spark, sf, "externals"))


def tables(spark, sf) -> DataFrame:
    return external.external_tables(relation(spark, sf, "externals"), external.activity(matched(spark, sf)))


@query("external_matching", f"{_WITH}, {MATCH} select ext_id, least(cls, 3) as match_class, count(*) as segments from mat group by all")
def external_matching(spark, sf):
    return matched(spark, sf).groupBy("ext_id", F.least(F.col("match_rank") + 1, F.lit(3)).alias("match_class")).agg(F.count("*").alias("segments"))


@query("external_activity", f"{_WITH}, {MATCH}, {ACT} select * exclude (scan_gb, external_duration_s), {_r('scan_gb', 'external_duration_s', digits=3)} from act")
def external_activity(spark, sf):
    return rounded(external.activity(matched(spark, sf)), "scan_gb", "external_duration_s", digits=3)


_T = ["partition_pruning_pct", "avg_files_per_segment", "files_per_query"]


@query("external_tables", f"{_CHAIN} select ext_id, external_table_key, query_count, {_BAND}, {_r(*_T, digits=3)} from ext")
def external_tables(spark, sf):
    return rounded(tables(spark, sf).select("ext_id", "external_table_key", "query_count", "pruning_band", *_T), *_T, digits=3)


def starred(spark, sf) -> DataFrame:
    """The catalogue with everything known of each table."""
    found = matched(spark, sf)
    seg = relation(spark, sf, "segments")
    bare = F.when(F.col("query_id") % 2 == 0, F.substring_index("table_name", ".", -1)).otherwise(F.concat(F.lit("x."), F.col("table_name")))
    steps = seg.where("table_name <> '' and query_id % 3 <> 0").select("query_id", "segment_id", bare.alias("step_table"), F.expr("returned_rows div (segment_id * 4)").alias("output_rows"), (F.col("query_id") % 50).alias("spill_blocks"))
    errors = seg.where("warning is not null").groupBy(F.expr("query_id * 10 + segment_id").alias("error_id")).agg(F.min("file_location").alias("file_location"), F.min(F.expr("query_id % 5")).alias("error_code"))
    columns = spark.read.parquet(f"{sf}/supplier.parquet").select(F.expr("'spectrum_' || cast(s_suppkey % 4 as string) || '.ext_' || cast(s_suppkey as string)").alias("external_table_key"), F.expr("cast(s_suppkey % 9 + 1 as bigint)").alias("column_count"))
    catalog = relation(spark, sf, "externals")
    return external.star(catalog, external.activity(found), columns, external.output_rollup(external.step_outputs(found, steps)), external.errors_matched(errors, catalog))


@query("external_star", f"{_CHAIN}, {OUT} select ext_id, external_table_key, column_count, query_count, output_metric_match_count, external_spill_blocks, {near_sql('row_filter_efficiency_pct', 2)} as row_filter_efficiency_pct, error_count, error_codes from full_")
def external_star(spark, sf):
    found = rounded(starred(spark, sf), "row_filter_efficiency_pct", digits=2)
    return found.select("ext_id", "external_table_key", "column_count", "query_count", "output_metric_match_count", "external_spill_blocks", "row_filter_efficiency_pct", "error_count", "error_codes")


@query("external_assessment", f"{_CHAIN}, {OUT}, {ISSUES} select ext_id, coalesce(score, 0) as score, coalesce(codes, '') as issue_codes, case when coalesce(score, 0) >= 70 then 'critical' when score >= 45 then 'high' when score >= 20 then 'medium' when score > 0 then 'low' else 'none' end as priority, case when query_count >= 5 and ms then 'high' else 'medium' end as confidence from fa left join sc using (ext_id)")
def external_assessment(spark, sf):
    found = external.assessed(starred(spark, sf))
    return found.select("ext_id", "score", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("issue_codes"), "priority", "confidence")


@query("spectrum_scanned", f"{_CHAIN} select ext_id, external_table_key, query_count, {near_sql('scan_gb', 3)} as scan_gb, row_number() over (order by scan_gb desc, ext_id) as place from ext where scan_gb > 0")
def spectrum_scanned(spark, sf):
    found = grouping.placed(external.scanned_most(tables(spark, sf)), "scan_gb", [F.desc("scan_gb"), F.asc("ext_id")], "place")
    return rounded(found.select("ext_id", "external_table_key", "query_count", "scan_gb", "place"), "scan_gb", digits=3)


@query("spectrum_unpartitioned", f"{_CHAIN} select ext_id, external_table_key, query_count, {near_sql('scan_gb', 3)} as scan_gb from ext where query_count > 0 and partition_keys <= 0")
def spectrum_unpartitioned(spark, sf):
    return rounded(external.unpartitioned(tables(spark, sf)).select("ext_id", "external_table_key", "query_count", "scan_gb"), "scan_gb", digits=3)


@query("external_from_activity", f"{_WITH} select distinct case when contains(table_name, '.') then string_split(lower(table_name), '.')[-2] else '' end as schema_name, string_split(lower(table_name), '.')[-1] as table_name from segments where table_name <> ''")
def external_from_activity(spark, sf):
    return external.from_activity(relation(spark, sf, "segments"))


_ROOT = r"regexp_extract(file_location, '^(s3://[^/]+/[^/]+)', 1)"


@query("external_hourly", rf"{_WITH}, s as (select *, {_ROOT} as file_root, query_id % 24 as hour from segments), sl as (select file_root, hour, count(distinct query_id) as queries, count(*) as n, avg(duration) as a, sum(returned_rows) as r, min(s3list_time) as lo, max(s3list_time) as hi from s group by all) select file_root, cast(sum(queries) as bigint) as query_slices, cast(sum(n) as bigint) as segments, {near_sql('sum(a * n) / sum(n)', 2)} as avg_duration, cast(sum(r) as bigint) as returned_rows, min(lo) as least_list_ms, max(hi) as most_list_ms from sl group by file_root")
def external_hourly(spark, sf):
    s = relation(spark, sf, "segments").withColumn("file_root", F.regexp_extract("file_location", "^(s3://[^/]+/[^/]+)", 1))
    return rounded(external.hourly_rollup(s, F.expr("query_id % 24")), "avg_duration", digits=2)


@query("external_severity", f"{_CHAIN} select ext_id, case when coalesce(partition_pruning_pct, 0) < 10 then 3 when coalesce(partition_pruning_pct, 0) < 50 then 2 when coalesce(partition_pruning_pct, 0) < 90 then 1 else 0 end as by_partition, case when coalesce(scanned_files, 0) > 100000 then 3 when coalesce(scanned_files, 0) > 10000 then 2 when coalesce(scanned_files, 0) > 100 then 1 else 0 end as by_files from ext")
def external_severity(spark, sf):
    t = tables(spark, sf)
    for m in ("partition", "files"):
        t = external.severity(t, m).withColumn(f"by_{m}", F.col("severity").cast("int"))
    return t.select("ext_id", "by_partition", "by_files")


@query("external_errors", f"{_WITH}, e as (select query_id * 10 + segment_id as error_id, min(file_location) as file_location, min(query_id % 5) as error_code from segments group by 1), m as (select error_id, error_code, ext_id from e join externals on starts_with(file_location, location) qualify row_number() over (partition by error_id order by length(location) desc, ext_id) = 1) select ext_id, count(*) as error_count, count(distinct error_code) as error_codes from m group by ext_id")
def external_errors(spark, sf):
    e = relation(spark, sf, "segments").groupBy(F.expr("query_id * 10 + segment_id").alias("error_id")).agg(F.min("file_location").alias("file_location"), F.min(F.expr("query_id % 5")).alias("error_code"))
    return external.errors_matched(e, relation(spark, sf, "externals"))


_COLS = "cols as (select 'ext_' || cast(n_nationkey as varchar(20)) as external_table_key, cast(p_size as bigint) as column_number, 'c_' || cast(p_partkey as varchar(20)) as column_name, p_brand as data_type, case when p_size <= 2 then p_size else 0 end as partition_key_ordinal, p_partkey % 2 = 0 as is_nullable from {part} join {nation} on n_nationkey = p_partkey % 25)"


@query("external_columns", f"with {_COLS.replace('{', '').replace('}', '')} select external_table_key, count(*) as column_count, count(*) filter (is_nullable) as nullable_count, string_agg(column_name, ',' order by column_number, column_name) as columns, coalesce(string_agg(column_name, ',' order by partition_key_ordinal, column_name) filter (partition_key_ordinal > 0), '') as partition_keys, array_to_string(list_sort(list(distinct data_type)), ',') as data_types, array_to_string(list(column_name order by column_number, column_name)[1:12], ',') as preview from cols group by external_table_key")
def external_columns(spark, sf):
    text = _COLS.replace("{part}", f"parquet.`{sf}/part.parquet`").replace("{nation}", f"parquet.`{sf}/nation.parquet`")
    return external.column_tiles(spark.sql(f"with {text} select * from cols"))
