"""Per-query and per-table rollups of telemetry.

Counts of distinct segments, streams or tables of one query use the size of a collected set: the sets are
bounded by one query's steps, and unlike several count(distinct) they need no expansion of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import ratio, zero


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _total(value: str, condition: Column | None = None) -> Column:
    v = F.coalesce(F.col(value), F.lit(0))
    return F.sum(v if condition is None else F.when(condition, v).otherwise(0))


#: Sources of steps that read outside the warehouse.
EXTERNAL = ("s3", "external", "spectrum")


def step_rollup(steps: DataFrame) -> DataFrame:
    """One row per query: sums, maxima, conditional counts and guarded ratios of its steps."""
    name, outer = F.lower(F.coalesce("step_name", F.lit(""))), F.lower(F.coalesce("source", F.lit(""))).isin(*EXTERNAL)
    found = steps.groupBy("query_id").agg(
        F.count("*").alias("step_cnt"),
        F.size(F.collect_set("segment_id")).cast("long").alias("segment_cnt"),
        F.size(F.collect_set("stream_id")).cast("long").alias("stream_cnt"),
        F.size(F.collect_set("table_id")).cast("long").alias("table_cnt"),
        _total("input_rows").alias("input_rows"),
        _total("output_rows").alias("output_rows"),
        _total("input_bytes").alias("input_bytes"),
        _total("spill_local").alias("local_spill"),
        _total("spill_remote").alias("remote_spill"),
        F.max("data_skewness").alias("max_data_skewness"),
        F.max("time_skewness").alias("max_time_skewness"),
        _total("local_read_io").alias("local_read_io"),
        _total("remote_read_io").alias("remote_read_io"),
        _total("duration").alias("duration"),
        _total("duration", outer).alias("external_duration"),
        _count(outer).alias("external_steps"),
        _count(F.lower(F.coalesce("source", F.lit(""))) == "s3").alias("s3_steps"),
        _count(name.contains("join")).alias("join_steps"),
        _count(name.contains("agg")).alias("agg_steps"),
        _count(name.contains("sort")).alias("sort_steps"),
        _count(name.contains("scan")).alias("scan_steps"),
        _count(F.trim(F.coalesce("alert", F.lit(""))) != "").alias("alert_count"),
        _total("input_rows", outer).alias("ext_input_rows"),
        _total("output_rows", outer).alias("ext_output_rows"),
        _total("spill_remote", outer).alias("external_spill_blocks"),
    )
    return (
        found.withColumn("total_spill", F.col("local_spill") + F.col("remote_spill"))
        .withColumn("remote_io_ratio", ratio("remote_read_io", F.col("remote_read_io") + F.col("local_read_io")))
        .withColumn("external_duration_pct", ratio("external_duration", "duration"))
        .withColumn("selectivity_ratio", ratio("output_rows", "input_rows"))
        .withColumn("ext_selectivity", ratio("ext_output_rows", "ext_input_rows"))
    )


#: Counters of plan nodes by what their text holds; the flags say only whether one is there.
PLAN_COUNTS = {
    "seq_scan_cnt": "seq scan",
    "s3_scan_cnt": "s3 seq scan",
    "dist_both_cnt": "ds_dist_both",
    "bcast_cnt": "ds_bcast_inner",
    "dist_total_cnt": "ds_dist_",
    "has_nested_loop": "nested loop",
    "hash_join_cnt": "hash join",
    "subquery_cnt": "subquery scan",
    "network_cnt": "network",
    "partition_loop_cnt": "partition loop",
    "missing_stats_flag": "missing statistics",
    "filter_node_cnt": "filter:",
    "sort_node_cnt": "sort",
    "agg_node_cnt": "agg",
}
PLAN_FLAGS = ("has_nested_loop", "missing_stats_flag")


def _plan_counts(plans: DataFrame, text: Column) -> DataFrame:
    node = F.lower(F.coalesce("plan_node", F.lit("")))
    return plans.where(F.col("query_id").isNotNull()).groupBy("query_id").agg(
        F.count("*").alias("node_cnt"),
        *[(F.max(text.contains(word).cast("long")) if k in PLAN_FLAGS else _count(text.contains(word))).alias(k) for k, word in PLAN_COUNTS.items()],
        F.max(F.regexp_extract(node, r"rows=(\d+)", 1).try_cast("bigint")).alias("max_plan_rows"),
        F.max(F.regexp_extract(node, r"cost=[0-9.]*?\.\.([0-9]+)", 1).try_cast("bigint")).alias("max_plan_cost"),
    )


def _tier(heavy: Column, wide: Column, plain: Column) -> Column:
    return F.when(heavy > 50, "VERY_EXPENSIVE").when(wide > 20, "EXPENSIVE").when(plain > 10, "MODERATE").otherwise("LIGHT")


def _issue(with_filter: bool) -> Column:
    out = F.when(F.col("dist_both_cnt") > 0, "BAD_DISTRIBUTION").when(F.col("has_nested_loop") > 0, "NESTED_LOOP_RISK").when(F.col("s3_scan_cnt") > 0, "S3_HEAVY").when(F.col("missing_stats_flag") > 0, "MISSING_STATS").when(F.col("seq_scan_cnt") > 5, "SCAN_HEAVY")
    return (out.when(F.col("filter_node_cnt") > 3, "FILTER_HEAVY") if with_filter else out).otherwise("GENERAL")


def _cost(*terms: tuple[int, str]) -> Column:
    return sum((F.col(c) * w for w, c in terms[1:]), F.col(terms[0][1]) * terms[0][0])


_SHARED = ((1, "seq_scan_cnt"), (3, "s3_scan_cnt"), (5, "dist_both_cnt"), (2, "bcast_cnt"), (10, "has_nested_loop"), (8, "missing_stats_flag"), (2, "partition_loop_cnt"))


def plan_rollup(plans: DataFrame) -> DataFrame:
    """Plan health as computed at capture: plan_node only, no filter or sort terms."""
    found = _plan_counts(plans, F.lower(F.coalesce("plan_node", F.lit(""))))
    seq, s3 = F.col("seq_scan_cnt"), F.col("s3_scan_cnt")
    heavy = F.col("dist_both_cnt") * 5 + F.col("has_nested_loop") * 10
    return found.withColumn("cost_score", _cost(*_SHARED)).withColumn("dominant_issue", _issue(False)).withColumn("cost_tier", _tier(heavy, seq + 3 * s3, seq + s3))


def plan_rollup_local(plans: DataFrame) -> DataFrame:
    """Plan health of the stored plan: node and info text, with filter and sort terms."""
    text = F.lower(F.concat(F.coalesce("plan_node", F.lit("")), F.lit(" "), F.coalesce("plan_info", F.lit(""))))
    found = _plan_counts(plans, text)
    seq, s3 = F.col("seq_scan_cnt"), F.col("s3_scan_cnt")
    heavy = F.col("dist_both_cnt") * 5 + F.col("has_nested_loop") * 10 + F.col("filter_node_cnt") + F.col("sort_node_cnt")
    return found.withColumn("cost_score", _cost(*_SHARED, (1, "filter_node_cnt"), (1, "sort_node_cnt"))).withColumn("dominant_issue", _issue(True)).withColumn("cost_tier", _tier(heavy, seq + 3 * s3, seq + s3))


def step_flow(steps: DataFrame, rows_per_query: int = 300) -> DataFrame:
    """Steps grouped by their identity, scored for pain and ranked twice within the query; the first rows by execution order stay."""
    keys = ["query_id", "stream_id", "segment_id", "step_id", "step_name", "table_id", "source"]
    found = steps.groupBy(*keys).agg(
        _total("input_rows").alias("input_rows"),
        _total("output_rows").alias("output_rows"),
        _total("spill_local").alias("local_spill"),
        _total("spill_remote").alias("remote_spill"),
        F.max("data_skewness").alias("data_skewness"),
        F.max("time_skewness").alias("time_skewness"),
        _total("local_read_io").alias("local_read_io"),
        _total("remote_read_io").alias("remote_read_io"),
        _total("duration").alias("duration"),
        F.max("alert").alias("alert"),
    )
    name, rows = F.lower(F.coalesce("step_name", F.lit(""))), F.greatest("input_rows", "output_rows")
    skew = lambda c: F.when(F.col(c) >= 3, 15).when(F.col(c) >= 2, 8).otherwise(0)
    flag = lambda c, w: F.when(c, w).otherwise(0)
    outer = F.coalesce(F.col("source") != "internal", F.lit(False))
    far, large_join, large_scan = F.col("remote_read_io") > F.col("local_read_io"), name.contains("join") & (rows >= 10_000_000), name.contains("scan") & (rows >= 10_000_000)
    pain = F.least(F.col("remote_spill") / 1000, F.lit(25)) + F.least(F.col("local_spill") / 1000, F.lit(15)) + flag(F.col("alert").isNotNull(), 20) + skew("data_skewness") + skew("time_skewness") + flag(far, 10) + flag(outer, 8) + flag(large_join, 8) + flag(large_scan, 6)
    tests = [("ALERT", F.col("alert").isNotNull()), ("REMOTE_SPILL", F.col("remote_spill") > 0), ("LOCAL_SPILL", F.col("local_spill") > 0), ("DATA_SKEW", F.col("data_skewness") >= 2), ("TIME_SKEW", F.col("time_skewness") >= 2), ("REMOTE_IO", far), ("EXTERNAL_SOURCE", outer), ("LARGE_JOIN", large_join), ("LARGE_SCAN", large_scan)]
    dominant = F.lit("NORMAL")
    for k, c in reversed(tests):
        dominant = F.when(c, F.lit(k)).otherwise(dominant)
    scored = found.withColumn("pain_score", pain).withColumn("dominant_pain", dominant).withColumn("pain_points", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests])), ","))
    last = [F.col(c).asc_nulls_last() for c in ("table_id", "source", "step_name")]
    flow = W.partitionBy("query_id").orderBy("stream_id", "segment_id", "step_id", *last)
    worst = W.partitionBy("query_id").orderBy(F.desc("pain_score"), F.desc("duration"), "stream_id", "segment_id", "step_id", *last)
    ranked = scored.withColumn("execution_rank", F.row_number().over(flow).cast("long")).withColumn("pain_rank", F.row_number().over(worst).cast("long"))
    return ranked.where(F.col("execution_rank") <= max(rows_per_query, 25))


def scan_rollup(scans: DataFrame) -> DataFrame:
    """Scans per query and table: name parts, distinct queries by kind of scan."""
    part = lambda i: F.lower(F.split_part("full_table_name", F.lit("."), F.lit(i)))
    return scans.groupBy("query_id", "full_table_name").agg(
        F.count("*").alias("scan_cnt"),
        (_total("duration") / 1e6).alias("duration_s"),
        (_total("input_rows") / 1e6).alias("input_rows_m"),
        # a row's one query counts or not: no sets are needed
        F.max(F.when(F.col("is_rrscan") & F.col("query_id").isNotNull(), 1).otherwise(0)).cast("long").alias("rrscan_queries"),
        F.max(F.when(~F.col("is_rrscan") & F.col("query_id").isNotNull(), 1).otherwise(0)).cast("long").alias("non_rrscan_queries"),
    ).select("query_id", part(1).alias("table_database"), part(2).alias("schema_name"), part(3).alias("table_name"), "scan_cnt", "duration_s", "input_rows_m", "rrscan_queries", "non_rrscan_queries")


def table_scans(scans: DataFrame) -> DataFrame:
    """Scans per table over all queries, pre-aggregated per query so the distinct counts are plain sums."""
    per = scan_rollup(scans)
    both = F.greatest("rrscan_queries", "non_rrscan_queries")
    out = per.groupBy("table_database", "schema_name", "table_name").agg(F.sum(both).alias("scan_query_count"), F.sum("duration_s").alias("scan_duration_s"), F.sum("input_rows_m").alias("scan_input_rows_m"), F.sum("rrscan_queries").alias("rrscan_queries"), F.sum("non_rrscan_queries").alias("non_rrscan_queries"))
    return out.withColumn("rrscan_query_pct", ratio("rrscan_queries", "scan_query_count")).withColumn("full_scan_query_pct", ratio("non_rrscan_queries", "scan_query_count"))


def assembled(fragments: DataFrame, *keys: str) -> DataFrame:
    """Statement text put together from its fragments in sequence order (nulls last)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("sequence").isNull().alias("last"), "sequence", "text")))
    return fragments.where(F.col("text").isNotNull()).groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("sql_text"), F.count("*").alias("fragment_cnt"))


def known_users(users: DataFrame) -> DataFrame:
    """One name per namespace and user."""
    return users.groupBy("namespace_id", "user_id").agg(F.max("user_name").alias("user_name"))
