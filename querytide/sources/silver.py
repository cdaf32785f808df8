"""The typed layer: views of the stored all-text tables in the columns and types that operators read.

A stored table holds text only and may lack columns of its contract. A view trims, turns the tokens for
null into null, casts what fits and nulls what does not; a column that the table lacks is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import duration_seconds, fragment, moment, ratio, real, token, whole

_CASTS = {"text": token, "raw": fragment, "long": whole, "real": real, "time": moment}
_NULLS = {"text": "string", "raw": "string", "long": "bigint", "real": "double", "time": "timestamp_ntz"}
_HEAD = "snapshot_id captured_at:time namespace_id"

# The columns of each view in order. name:type (text without one); name=stored name where they differ.
# raw: text that keeps its blanks. key(a.b.c): the dotted lower-case key of stored columns. seconds(a): a duration in seconds.
VIEWS = {
    "query_details": f"""{_HEAD} query_id:long total_spill:real input_bytes:real output_bytes:real blocks_read:real blocks_write:real local_read_io:real remote_read_io:real
 input_rows:real output_rows:real selectivity_ratio:real total_step_duration_us=total_step_duration:real max_step_duration_us=max_step_duration:real
 avg_step_duration_us=avg_step_duration:real total_steps:real max_data_skewness:real max_time_skewness:real segments_used:real streams_used:real scan_steps:real
 join_steps:real sort_steps:real agg_steps:real tables_touched:real alert_count:real external_steps:real s3_steps:real external_input_bytes:real external_input_rows:real
 external_duration_us=external_duration:real external_duration_pct:real remote_io_ratio:real external_selectivity:real external_spill_blocks:real
 external_tables_touched:real external_data_skew:real""",
    "query_health": f"""{_HEAD} query_id:long seq_scan_cnt:real s3_scan_cnt:real partition_loop_cnt:real dist_both_cnt:real bcast_cnt:real dist_total_cnt:real
 has_nested_loop:real hash_join_cnt:real subquery_cnt:real network_cnt:real missing_stats_flag:real max_est_rows:real max_cost:real cost_score:real dominant_issue cost_tier""",
    "query_explain": f"{_HEAD} user_id=user_id|userid:long query_id:long child_query_sequence:long plan_node_id:long plan_parent_id:long plan_node:raw plan_info:raw",
    "query_detail_flow": f"""{_HEAD} user_id:long query_id:long child_query_sequence:long metrics_level step_name step_id:long step_attribute stream_id:long segment_id:long
 plan_node_id:long plan_parent_id:long start_time:time end_time:time duration_us=duration:real duration_s=seconds(duration) table_id:long table_name source is_rrscan
 input_bytes:real input_rows:real output_bytes:real output_rows:real blocks_read:real blocks_write:real local_read_io:real remote_read_io:real
 spilled_block_local_disk:real spilled_block_remote_disk:real data_skewness:real time_skewness:real alert detail_row_count:long max_duration_us=max_duration:real
 max_duration_s=seconds(max_duration) alert_count:real pain_score:real dominant_pain pain_points detail_row_rank:long pain_rank:long""",
    "table_info": f"""{_HEAD} source_db=source_db|database database_name=database schema_name=schema table_id:long table_name=table
 table_key=key(namespace_id.source_db|database.schema.table) encoded diststyle sortkey1 sortkey_num:real size_mb=size:real pct_used:real empty_blocks=empty:real
 unsorted_pct=unsorted:real stats_off:real tbl_rows:real skew_sortkey1:real skew_rows:real estimated_visible_rows:real risk_event vacuum_sort_benefit:real create_time:time""",
    "external_table_info": f"""{_HEAD} external_table_key=key(namespace_id.external_table_key) redshift_database_name schema_name table_name s3_location table_type input_format
 output_format serialization_lib serde_parameters compressed:long table_parameters column_count:long partition_key_count:long partition_key_columns
 catalog_partition_count:long observation_start_time:time observation_end_time:time query_count:long external_segment_count:long user_count:long gross_scan_bytes:real
 gross_scan_gb:real gross_output_bytes:real gross_output_gb:real gross_scan_rows:real gross_output_rows:real output_metric_match_count:long
 output_to_scan_byte_ratio:real byte_reduction_pct_estimate:real output_to_scan_row_ratio:real row_filter_efficiency_pct:real filtering_assessment
 total_partitions_considered:real qualified_partitions_scanned:real partition_pruning_pct:real pruning_event_count:long no_pruning_event_count:long scanned_files:real
 avg_files_per_segment:real max_files_per_segment:real external_duration_s:real avg_external_duration_s:real max_external_duration_s:real s3list_time_ms:real
 avg_s3list_time_ms:real max_s3list_time_ms:real get_partition_time_total_raw:real avg_get_partition_time_raw:real max_get_partition_time_raw:real
 get_partition_time_unit recursive_scan_count:long nested_scan_count:long warning_event_count:long security_warning_count:long partition_warning_count:long
 schema_format_warning_count:long file_location_warning_count:long connectivity_warning_count:long other_warning_count:long warning_example sampled_error_count:long
 queries_with_sampled_errors:long truncation_error_count:long overflow_error_count:long invalid_data_error_count:long null_handling_error_count:long
 other_error_count:long distinct_error_code_count:long affected_column_count:long max_data_skewness:real max_time_skewness:real external_spill_blocks:real
 observed_file_format""",
    "table_scan_info": f"""{_HEAD} query_id:long full_table_name table_database schema_name table_name table_key=key(namespace_id.table_database.schema_name.table_name)
 scan_query_count=queries:real scan_duration_s=duration_s:real scan_input_rows_m=input_rows_m:real scan_output_rows_m=output_rows_m:real
 rrscan_query_count=rrscan_queries:real non_rrscan_query_count=non_rrscan_queries:real rrscan_query_pct=ratio(rrscan_queries/queries)
 full_scan_query_pct=ratio(non_rrscan_queries/queries)""",
    "view_definitions": f"{_HEAD} database schema view_name view_key=key(namespace_id.database.schema.view_name) source_definition:raw",
    "procedure_definitions": f"""{_HEAD} database schema procedure_name procedure_key=key(namespace_id.procedure_key|database.schema.procedure_name) procedure_oid owner_id
 owner_name argument_names argument_modes argument_type_oids all_argument_type_oids source_length:real source_definition:raw""",
}
#: Views without rows that have no query.
_NEED_QUERY = ("query_explain", "query_detail_flow")


def columns(view: str) -> list[tuple[str, str, str]]:
    """(name, stored expression, type) of a view's columns."""
    out = []
    for word in VIEWS[view].split():
        name, _, rest = word.partition("=")
        if not rest:
            name, _, kind = word.partition(":")
            out.append((name, name, kind or "text"))
        else:
            source, _, kind = rest.partition(":")
            out.append((name, source, kind or "text"))
    return out


def stored(view: str) -> dict[str, str]:
    """Stored columns that a view reads, with the type that they stand for."""
    out: dict[str, str] = {}
    for _, source, kind in columns(view):
        call, _, inner = source.rstrip(")").partition("(")
        if not inner:
            out |= {c: kind for c in source.split("|")}
        elif call == "key":
            out |= {c: out.get(c, "text") for part in inner.split(".") for c in part.split("|")}
        else:
            out |= {c: "real" for c in inner.split("/")}
    return out


#: Longer methods HotSpot leaves to its interpreter.
METHOD_BYTES = 8000


def short_methods(spark: SparkSession) -> None:
    """Lowers the session's limit of generated methods to METHOD_BYTES, beyond which Spark generates code by operator; a smaller setting stays."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > METHOD_BYTES:
        spark.conf.set(name, str(METHOD_BYTES))


def view(bronze: DataFrame, name: str) -> DataFrame:
    """The typed view `name` of a stored table. Its columns are too many for one generated method."""
    short_methods(bronze.sparkSession)

    def of(column: str, kind: str) -> Column:
        return _CASTS[kind](f"`{column}`") if column in bronze.columns else F.lit(None).cast(_NULLS[kind])

    def first(choice: str, kind: str = "text") -> Column:
        return F.coalesce(*[of(c, kind) for c in choice.split("|")])

    def one(source: str, kind: str) -> Column:
        call, _, inner = source.rstrip(")").partition("(")
        if call == "seconds" and inner:
            return duration_seconds(of(inner, "real"))
        if call == "ratio" and inner:
            part, all_of = inner.split("/")
            return ratio(of(part, "real"), of(all_of, "real"))
        if call == "key" and inner:
            names = inner.split(".")
            dotted = lambda xs: F.concat_ws(".", *[F.coalesce(first(x), F.lit("")) for x in xs])
            if names[1].startswith("procedure_key|"):  # a stored key stands for the three names
                return F.lower(F.coalesce(F.concat(F.coalesce(first(names[0]), F.lit("")), F.lit("."), of("procedure_key", "text")), dotted([names[0], names[1].partition("|")[2], *names[2:]])))
            return F.lower(dotted(names))
        return first(source, kind)

    out = bronze.select(*[one(source, kind).alias(column) for column, source, kind in columns(name)])
    if name == "query_explain":
        out = out.withColumn("plan_text_lc", F.lower(F.concat(F.coalesce("plan_node", F.lit("")), F.lit(" "), F.coalesce("plan_info", F.lit("")))))
    return out.where("query_id is not null") if name in _NEED_QUERY else out
