"""Rollups of captured step details: per query, and per step with pain scores and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import ratio, zero
from .rollups import EXTERNAL

#: What makes a row of the grouped flow.
FLOW_KEYS = ["user_id", "query_id", "child_query_sequence", "metrics_level", "step_name", "step_id", "step_attribute", "stream_id", "segment_id", "plan_node_id", "plan_parent_id", "table_id", "table_name", "source", "is_rrscan"]
_FLOW_SUMS = ["duration", "input_bytes", "input_rows", "output_bytes", "output_rows", "blocks_read", "blocks_write", "local_read_io", "remote_read_io", "spilled_block_local_disk", "spilled_block_remote_disk"]
LARGE_ROWS, LEAST_ROWS = 10_000_000, 25


def _alert() -> Column:
    a = F.trim(F.col("alert").cast("string"))
    return F.when(a != "", a)


def details_rollup(details: DataFrame) -> DataFrame:
    """One row per query over its captured steps. Sums skip nulls: what no step reports stays null, and a spill counts where both disks report.

    Distinct counts are sizes of sets, which one query's steps bound."""
    name, outer = F.lower(F.coalesce("step_name", F.lit(""))), F.lower("source").isin(*EXTERNAL)
    n = lambda c: F.count(F.when(c, 1))
    different = lambda c: F.size(F.collect_set(c)).cast("long")
    of_outer = lambda c: F.sum(F.when(outer, F.col(c)))
    found = details.groupBy("query_id").agg(
        F.sum(F.col("spilled_block_local_disk") + F.col("spilled_block_remote_disk")).alias("total_spill"),
        *[F.sum(c).alias(c) for c in ("input_bytes", "output_bytes", "blocks_read", "blocks_write", "local_read_io", "remote_read_io", "input_rows", "output_rows")],
        F.sum("duration").alias("total_step_duration"), F.max("duration").alias("max_step_duration"), F.avg("duration").alias("avg_step_duration"),
        F.count("*").alias("total_steps"), F.max("data_skewness").alias("max_data_skewness"), F.max("time_skewness").alias("max_time_skewness"),
        different("segment_id").alias("segments_used"), different("stream_id").alias("streams_used"),
        *[n(name.contains(w)).alias(f"{w}_steps") for w in ("scan", "join", "sort", "agg")],
        different("table_id").alias("tables_touched"), F.count(_alert()).alias("alert_count"),
        n(outer).alias("external_steps"), n(F.lower("source") == "s3").alias("s3_steps"),
        of_outer("input_bytes").alias("external_input_bytes"), of_outer("input_rows").alias("external_input_rows"), of_outer("output_rows").alias("_external_output_rows"), of_outer("duration").alias("external_duration"),
        of_outer("spilled_block_remote_disk").alias("external_spill_blocks"), different(F.when(outer, F.col("table_name"))).alias("external_tables_touched"), F.max(F.when(outer, F.col("data_skewness"))).alias("external_data_skew"),
        F.sum(F.col("local_read_io") + F.col("remote_read_io")).alias("_reads"),
    )
    return found.withColumns({
        "selectivity_ratio": ratio("output_rows", "input_rows"), "external_duration_pct": ratio("external_duration", "total_step_duration"),
        "remote_io_ratio": ratio("remote_read_io", "_reads"), "external_selectivity": ratio("_external_output_rows", "external_input_rows"),
    }).drop("_reads", "_external_output_rows")


def grouped_flow(details: DataFrame, rows_per_query: int = 300) -> DataFrame:
    """Steps grouped by their fifteen keys, with pain scores and two ranks inside their query: by execution, and by pain.

    The first rows of each query by execution stay, LEAST_ROWS at least. Steps are dealt by query once, before they are grouped:
    the groups and both ranks lie inside a query, and steps are narrower than the half-made groups."""
    kept = details.where(F.lower(F.coalesce("metrics_level", F.lit(""))).isin("step", "child query") | F.col("step_id").isNotNull() | F.col("plan_node_id").isNotNull())
    rows = kept.repartition("query_id").groupBy(*FLOW_KEYS).agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), *[F.sum(zero(c)).alias(c) for c in _FLOW_SUMS], F.max(zero("duration")).alias("max_duration"), F.count("*").alias("detail_row_count"),
        F.max(zero("data_skewness")).alias("data_skewness"), F.max(zero("time_skewness")).alias("time_skewness"), F.max(_alert()).alias("alert"), F.count(_alert()).alias("alert_count"),
    )
    col, name = F.col, F.lower(F.coalesce("step_name", F.lit("")))
    large = col("input_rows") >= LARGE_ROWS
    # code, whether it holds, and what it adds to the score
    pains = [
        ("ALERT", col("alert_count") > 0, F.lit(20.0)),
        ("REMOTE_SPILL", col("spilled_block_remote_disk") > 0, F.least(col("spilled_block_remote_disk") / 1000.0, F.lit(25.0))),
        ("LOCAL_SPILL", col("spilled_block_local_disk") > 0, F.least(col("spilled_block_local_disk") / 1000.0, F.lit(15.0))),
        ("DATA_SKEW", col("data_skewness") >= 3, F.lit(15.0)),
        ("TIME_SKEW", col("time_skewness") >= 3, F.lit(15.0)),
        ("REMOTE_IO", col("remote_read_io") > F.greatest(col("local_read_io"), F.lit(0)), F.lit(10.0)),
        ("EXTERNAL_SOURCE", F.lower(F.coalesce("source", F.lit("internal"))) != "internal", F.lit(8.0)),
        ("LARGE_JOIN", name.contains("join") & large, F.lit(8.0)),
        ("LARGE_SCAN", name.contains("scan") & large, F.lit(6.0)),
    ]
    score = sum((F.when(holds, points).otherwise(0.0) for _, holds, points in pains), F.lit(0.0))
    for c in ("data_skewness", "time_skewness"):  # a skew of two hurts, but gives the step no name
        score = score + F.when((col(c) >= 2) & (col(c) < 3), 8.0).otherwise(0.0)
    held = F.array_compact(F.array(*[F.when(holds, F.lit(code)) for code, holds, _ in pains]))
    rows = rows.withColumns({"pain_score": score, "_held": held}).withColumns({"dominant_pain": F.coalesce(F.get("_held", 0), F.lit("NORMAL")), "pain_points": F.array_join(F.transform("_held", lambda x: F.concat(x, F.lit(";"))), "")}).drop("_held")
    rest = [col(c).asc_nulls_first() for c in FLOW_KEYS if c != "query_id"]
    flow = [zero(c) for c in ("child_query_sequence", "stream_id", "segment_id", "step_id", "plan_node_id")] + [F.coalesce("start_time", "end_time").asc_nulls_last(), *rest]
    worst = [F.desc("pain_score"), F.desc("duration"), F.desc("input_rows"), *rest]
    by_query = W.partitionBy("query_id")
    ranked = rows.withColumns({"detail_row_rank": F.row_number().over(by_query.orderBy(*flow)), "pain_rank": F.row_number().over(by_query.orderBy(*worst))})
    return ranked.where(col("detail_row_rank") <= max(LEAST_ROWS, rows_per_query))
