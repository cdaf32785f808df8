"""Rule catalogues over slow queries and tables.

A catalogue is one pass over its input: every rule that fires becomes an entry of an array of structs,
which is exploded. (A union of one branch per rule would read and join the input once per rule.)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import impact_band, missing_sortkey


@dataclass(frozen=True)
class Rule:
    """A rule in SQL expressions over COALESCEd columns: it fires when `when` holds."""

    name: str
    when: str
    critical: str  # condition, or a fixed severity
    otherwise: str
    metric: str
    impact: str


def _r(name: str, when: str, critical: str, otherwise: str, metric: str, impact: str) -> Rule:
    return Rule(name, when, critical, otherwise, metric, impact)


_SEL, _EXT = "coalesce(selectivity_ratio_raw, 1)", "coalesce(ext_selectivity_raw, 1)"
QUERY_RULES = [
    _r("Q01_REMOTE_SPILL", "total_spill > 0", "total_spill >= 100000", "warn", "total_spill", "95 + least(total_spill / 1e5, 25)"),
    _r("Q02_EXTERNAL_SPILL", "external_spill_blocks > 0", "true", "warn", "external_spill_blocks", "94 + least(external_spill_blocks / 1e4, 20)"),
    _r("Q03_REMOTE_IO_RATIO", "remote_io_ratio >= 0.25", "remote_io_ratio >= 0.5", "warn", "remote_io_ratio", "88 + 20 * remote_io_ratio"),
    _r("Q04_DATA_SKEW_STEP", "max_data_skewness >= 4", "max_data_skewness >= 8", "warn", "max_data_skewness", "86 + least(max_data_skewness, 20)"),
    _r("Q05_TIME_SKEW_STEP", "max_time_skewness >= 4", "max_time_skewness >= 8", "warn", "max_time_skewness", "84 + least(max_time_skewness, 20)"),
    _r("Q06_BROADCAST_JOIN", "bcast_cnt > 0", "bcast_cnt >= 3", "warn", "bcast_cnt", "78 + 3 * bcast_cnt"),
    _r("Q07_DS_DIST_BOTH", "dist_both_cnt > 0", "true", "warn", "dist_both_cnt", "92 + 5 * dist_both_cnt"),
    _r("Q08_DIST_HEAVY", "dist_total_cnt >= 3", "dist_total_cnt >= 6", "warn", "dist_total_cnt", "75 + 2 * dist_total_cnt"),
    _r("Q09_NESTED_LOOP", "has_nested_loop > 0", "true", "warn", "has_nested_loop", "96"),
    _r("Q10_MISSING_STATS_PLAN", "missing_stats_flag > 0", "true", "warn", "missing_stats_flag", "89"),
    _r("Q11_S3_SCAN", "s3_scan_cnt + s3_steps > 0", "s3_scan_cnt + s3_steps >= 3", "warn", "s3_scan_cnt + s3_steps", "72 + 3 * (s3_scan_cnt + s3_steps)"),
    _r("Q12_EXTERNAL_SHARE", "external_duration_pct >= 0.25", "external_duration_pct >= 0.5", "warn", "external_duration_pct", "74 + 30 * external_duration_pct"),
    _r("Q13_EXTERNAL_LOW_SELECTIVITY", f"ext_input_rows >= 1000000 and {_EXT} <= 0.1", "false", "warn", "ext_input_rows", "70 + least(ext_input_rows / 1e7, 20)"),
    _r("Q14_SEQ_SCAN_HEAVY", "seq_scan_cnt >= 5", "seq_scan_cnt >= 10", "warn", "seq_scan_cnt", "64 + 2 * seq_scan_cnt"),
    _r("Q15_PARTITION_LOOP", "partition_loop_cnt > 0", "false", "warn", "partition_loop_cnt", "65 + 2 * partition_loop_cnt"),
    _r("Q16_NETWORK_NODE", "network_cnt > 0", "false", "warn", "network_cnt", "62 + 2 * network_cnt"),
    _r("Q17_HIGH_COST_SCORE", "cost_score >= 35", "cost_score >= 75", "warn", "cost_score", "60 + least(cost_score, 60)"),
    _r("Q18_ALERT_COUNT", "alert_count > 0", "alert_count >= 5", "warn", "alert_count", "58 + 3 * alert_count"),
    _r("Q19_ROW_EXPANSION", "selectivity_ratio >= 5", "selectivity_ratio >= 20", "warn", "selectivity_ratio", "68 + least(selectivity_ratio, 30)"),
    _r("Q20_INPUT_WASTE", f"input_rows >= 10000000 and {_SEL} <= 0.05", "false", "warn", "input_rows", "55 + least(input_rows / 1e8, 25)"),
    _r("Q21_SELECT_STAR", r"lower(sql_text) rlike 'select\\s+\\*'", "false", "info", "1", "35"),
    _r("Q22_LEADING_WILDCARD", r"lower(sql_text) rlike 'like\\s+''%'", "false", "warn", "1", "42"),
    _r("Q23_UNION_DISTINCT", "contains(lower(sql_text), 'union ') and not contains(lower(sql_text), 'union all')", "false", "info", "1", "32"),
    _r("Q24_CROSS_JOIN", "contains(lower(sql_text), 'cross join')", "true", "warn", "1", "90"),
    _r("Q25_ORDER_BY_NO_LIMIT", "contains(lower(sql_text), 'order by') and not contains(lower(sql_text), 'limit ')", "false", "warn", "1", "40"),
]
TABLE_RULES = [
    _r("T26_TABLE_SKEW", "skew_rows >= 3", "skew_rows >= 5", "warn", "skew_rows", "80 + least(3 * skew_rows, 25)"),
    _r("T27_UNSORTED", "unsorted_pct >= 20", "unsorted_pct >= 50", "warn", "unsorted_pct", "76 + least(unsorted_pct / 2, 25)"),
    _r("T28_STATS_OFF", "stats_off >= 10", "stats_off >= 25", "warn", "stats_off", "78 + least(stats_off / 2, 20)"),
    _r("T29_VACUUM_BENEFIT", "vacuum_sort_benefit >= 10", "false", "warn", "vacuum_sort_benefit", "64 + least(vacuum_sort_benefit, 20)"),
    _r("T30_LARGE_ALL_TABLE", "upper(diststyle) like 'ALL%' and size_mb >= 1024", "true", "warn", "size_mb", "82 + least(size_mb / 1000, 20)"),
    _r("T31_LARGE_EVEN_TABLE", "upper(diststyle) like 'EVEN%' and tbl_rows >= 100000000", "false", "info", "tbl_rows", "45 + least(tbl_rows / 1e9, 15)"),
    _r("T32_NO_SORTKEY_LARGE", "no_sortkey and (size_mb >= 1024 or tbl_rows >= 100000000)", "false", "warn", "size_mb", "66 + least(size_mb / 1000, 20)"),
]
_BIG = "input_rows >= 10000000"
REWRITE_RULES = [
    _r("R01_DATE_RANGE", rf"{_BIG} and {_SEL} <= 0.25 and lower(sql_text) rlike '(date|time|timestamp|between|_dt|_date)'", "true", "warn", "input_rows", "96 + least(input_rows / 1e8, 20)"),
    _r("R02_FILTER_EARLY", f"{_BIG} and {_SEL} <= 0.05", "input_rows >= 100000000", "warn", "input_rows", "90 + least(input_rows / 1e8, 20)"),
    _r("R03_PREAGGREGATE", f"{_BIG} and agg_steps > 0 and join_steps > 0", "false", "warn", "input_rows", "74 + least(input_rows / 1e8, 18)"),
    _r("R04_ALIGN_JOIN_KEYS", "dist_total_cnt >= 2 or dist_both_cnt > 0", "true", "warn", "dist_total_cnt", "88 + 4 * dist_total_cnt"),
    _r("R05_REDUCE_EXTERNAL", "external_duration_pct >= 0.25 or s3_scan_cnt > 0", "external_duration_pct >= 0.5", "warn", "external_duration_pct", "82 + 25 * external_duration_pct"),
    _r("R06_LIST_COLUMNS", r"lower(sql_text) rlike 'select\\s+\\*'", "false", "warn", "input_bytes", "60 + least(input_bytes / 1e9, 15)"),
    _r("R07_UNION_ALL", "contains(lower(sql_text), 'union ') and not contains(lower(sql_text), 'union all')", "false", "info", "input_rows", "50 + least(input_rows / 1e8, 12)"),
    _r("R08_LEADING_WILDCARD", r"lower(sql_text) rlike 'like\\s+''%'", "false", "warn", "input_rows", "58 + least(input_rows / 1e8, 12)"),
    _r("R09_LIMIT_SORT", "contains(lower(sql_text), 'order by') and not contains(lower(sql_text), 'limit ')", "false", "warn", "sort_steps", "56 + 4 * sort_steps"),
    _r("R10_FAN_OUT", "contains(lower(sql_text), 'cross join') or selectivity_ratio >= 5", "true", "warn", "selectivity_ratio", "94 + least(selectivity_ratio, 20)"),
    _r("R11_STAGE_JOIN", "total_spill > 0 or has_nested_loop > 0 or cost_score >= 50 or (max_data_skewness >= 4 and dist_total_cnt > 0)", "total_spill > 0 or has_nested_loop > 0", "warn", "total_spill", "84 + least(total_spill / 1e4, 20)"),
]
TABLE_REWRITE = _r("R01_TABLE_PARTITION", "lower(concat(sortkey1, ' ', table_name)) rlike '(date|time|dt|day|month|year)' and (size_mb >= 10240 or tbl_rows >= 1000000000 or table_risk_score >= 70)", "table_risk_score >= 80", "warn", "size_mb", "70 + least(size_mb / 1000, 20)")
QUERY_ACTIONS = [
    _r("A06_STAGED_JOIN", "dist_both_cnt > 0 or dist_total_cnt >= 4", "true", "warn", "dist_total_cnt", "86 + least(4 * dist_total_cnt, 30)"),
    _r("A07_EXTERNAL", "external_duration_pct >= 0.25 or s3_scan_cnt > 0", "external_duration_pct >= 0.5", "warn", "external_duration_pct", "80 + 35 * external_duration_pct"),
    _r("A08_FAN_OUT", "selectivity_ratio >= 5 or contains(lower(sql_text), 'cross join')", "true", "warn", "selectivity_ratio", "88 + least(selectivity_ratio, 25)"),
    _r("A09_QUEUE", "queue_s >= 20", "queue_s >= 60", "warn", "queue_s", "60 + least(queue_s / 2, 40)"),
    _r("A10_MEMORY", "total_spill > 0", "total_spill >= 100000", "warn", "total_spill", "82 + least(total_spill / 1e4, 35)"),
]
TABLE_ACTIONS = [
    _r("A01_BLAST_RADIUS", "slow_query_count >= 2 and blast_radius_score >= 60", "blast_radius_score >= 110", "warn", "blast_radius_score", "blast_radius_score"),
    _r("A02_ANALYZE", "stats_off >= 10 and slow_query_count > 0", "stats_off >= 35 or slow_query_count >= 8", "warn", "stats_off", "72 + least(stats_off, 40) + least(2 * slow_query_count, 25)"),
    _r("A03_VACUUM", "(unsorted_pct >= 20 or vacuum_sort_benefit >= 10) and slow_query_count > 0", "unsorted_pct >= 50 or vacuum_sort_benefit >= 35", "warn", "unsorted_pct", "70 + least(unsorted_pct / 1.2, 45) + least(2 * slow_query_count, 25)"),
    _r("A04_DISTRIBUTION", "redistribution_count > 0 or skew_rows >= 3", "redistribution_count >= 5 or skew_rows >= 5", "warn", "redistribution_count", "78 + least(5 * redistribution_count, 35) + least(4 * skew_rows, 25)"),
]
FAST_ACTIONS = [
    _r("F01_ANALYZE", "stats_off >= 10", "stats_off >= 35", "warn", "stats_off", "72 + least(stats_off, 45) + least(2 * scan_query_count, 25)"),
    _r("F02_VACUUM", "unsorted_pct >= 20 or vacuum_sort_benefit >= 10", "unsorted_pct >= 50 or vacuum_sort_benefit >= 35", "warn", "unsorted_pct", "70 + least(unsorted_pct / 1.2, 45) + least(4 * non_rrscan_queries, 25)"),
    _r("F03_SKEW", "skew_rows >= 3", "skew_rows >= 5", "warn", "skew_rows", "70 + least(8 * skew_rows, 40) + least(table_risk_score / 3, 25)"),
    _r("F04_HEAVY_SCANS", "avg_scan_s >= 120 or scan_input_rows_m >= 500", "avg_scan_s >= 600", "warn", "avg_scan_s", "62 + least(avg_scan_s / 60, 35) + least(scan_input_rows_m / 250, 25)"),
]


def hits(rules: list[Rule]) -> Column:
    """array<struct<rule_id, severity, metric_value, impact_score>> of the rules that fire for a row of operands."""

    def entry(r: Rule) -> Column:
        severity = F.when(F.expr(r.critical), "crit").otherwise(r.otherwise)
        body = F.struct(F.lit(r.name).alias("rule_id"), severity.alias("severity"), F.expr(r.metric).cast("double").alias("metric_value"), F.expr(r.impact).cast("double").alias("impact_score"))
        return F.when(F.expr(r.when), body)

    return F.filter(F.array(*[entry(r) for r in rules]), lambda x: x.isNotNull())


def fired(rows: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """One row per input row and rule that fires: keep columns, rule_id, severity, metric_value, impact_score."""
    return rows.select(*keep, F.explode(hits(rules)).alias("hit")).select(*keep, "hit.*")


def filled(rows: DataFrame, numbers: list[str], texts: list[str] = ()) -> DataFrame:
    """Operands as the rules take them: null numbers as 0 (raw copies of the two selectivities stay), null texts empty."""
    raw = {f"{c}_raw": F.col(c) for c in ("selectivity_ratio", "ext_selectivity") if c in rows.columns}
    return rows.withColumns(raw).withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in numbers if c in rows.columns} | {c: F.coalesce(F.col(c), F.lit("")) for c in texts if c in rows.columns})


def query_operands(slow: DataFrame) -> DataFrame:
    texts = {"sql_text", "dominant_issue", "cost_tier", "namespace_id"}
    numbers = [f.name for f in slow.schema.fields if f.name not in texts | {"query_id"} and f.dataType.typeName() in ("long", "integer", "double", "decimal")]
    return filled(slow, numbers, ["sql_text"])


def table_operands(tables: DataFrame) -> DataFrame:
    ready = tables.withColumn("no_sortkey", missing_sortkey("sortkey1"))
    numbers = [f.name for f in tables.schema.fields if f.dataType.typeName() in ("long", "integer", "double", "decimal") and f.name != "table_id"]
    return filled(ready, numbers, ["diststyle", "sortkey1", "table_name"])


def insights(slow: DataFrame, tables: DataFrame) -> DataFrame:
    """All insight rules: scope, subject (query or table id as text), rule_id, severity, metric_value, impact_score."""
    q = fired(query_operands(slow), QUERY_RULES, ["query_id"]).select(F.lit("query").alias("scope"), F.col("query_id").cast("string").alias("subject"), "rule_id", "severity", "metric_value", "impact_score")
    t = fired(table_operands(tables), TABLE_RULES, ["table_id"]).select(F.lit("table").alias("scope"), F.col("table_id").cast("string").alias("subject"), "rule_id", "severity", "metric_value", "impact_score")
    return q.unionByName(t)


def rewrites(slow: DataFrame, risky_tables: DataFrame) -> DataFrame:
    q = fired(query_operands(slow), REWRITE_RULES, ["query_id"]).select(F.lit("query").alias("scope"), F.col("query_id").cast("string").alias("subject"), "rule_id", "severity", "metric_value", "impact_score")
    t = fired(table_operands(risky_tables), [TABLE_REWRITE], ["table_id"]).select(F.lit("table").alias("scope"), F.col("table_id").cast("string").alias("subject"), "rule_id", "severity", "metric_value", "impact_score")
    return q.unionByName(t)


def family_summary(found: DataFrame) -> DataFrame:
    """Counts by severity and impact figures per rule."""
    n = lambda s: F.count(F.when(F.col("severity") == s, 1))
    return found.groupBy("rule_id").agg(F.count("*").alias("findings"), n("crit").alias("crit_count"), n("warn").alias("warn_count"), n("info").alias("info_count"), F.avg("impact_score").alias("avg_impact"), F.max("impact_score").alias("max_impact"))


METRIC_LABELS = {"SPILL": "blocks", "RATIO": "share", "SHARE": "share", "SKEW": "skew", "ROWS": "rows", "WASTE": "rows", "COST": "score"}


def decorated(found: DataFrame) -> DataFrame:
    """Findings with target type, metric label and impact band."""
    label = F.lit("count")
    for word, text in reversed(METRIC_LABELS.items()):
        label = F.when(F.col("rule_id").contains(word), F.lit(text)).otherwise(label)
    return found.withColumn("target_type", F.initcap("scope")).withColumn("metric_label", label).withColumn("impact_band", impact_band("impact_score"))


def capped(found: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first `most` rows, and whether more were there: one row beyond the cap is looked at, never all."""
    rows = found.orderBy(*order).limit(most + 1).withColumn("place", F.row_number().over(W.orderBy(*order)))
    more = F.max("place").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) > most
    return rows.withColumn("truncated", more).where(F.col("place") <= most).drop("place")
