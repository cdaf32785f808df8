"""Slow queries, table risk, references, impact, review, and the action queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import duration_seconds, elapsed_seconds, missing_sortkey, ratio, zero
from . import rules


def union_history(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """The primary history and those extra rows that it lacks (null-safe on namespace)."""
    p = primary.select(F.col("query_id").alias("p_id"), F.col("namespace_id").alias("p_ns"))
    rest = extra.join(p, (F.col("query_id") == F.col("p_id")) & F.col("namespace_id").eqNullSafe(F.col("p_ns")), "left_anti")
    return primary.unionByName(rest, allowMissingColumns=True)


def merged_health(captured: DataFrame, derived: DataFrame) -> DataFrame:
    """Full outer join of captured and plan-derived health; the captured value wins where it is set."""
    names = [c for c in derived.columns if c != "query_id"]
    d = derived.select(F.col("query_id").alias("d_id"), *[F.col(c).alias(f"d_{c}") for c in names])
    both = captured.join(d, F.col("query_id").eqNullSafe(F.col("d_id")), "full_outer")
    return both.select(F.coalesce("query_id", "d_id").alias("query_id"), *[F.coalesce(F.col(c) if c in captured.columns else F.lit(None), F.col(f"d_{c}")).alias(c) for c in names])


def slow_queries(history: DataFrame, steps: DataFrame, health: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per query known to any source, with elapsed time, queue time and risk score.

    The spine is the distinct ids of all four; every join is on query_id, so they share one partitioning."""
    spine = history.select("query_id").union(steps.select("query_id")).union(health.select("query_id")).union(texts.select("query_id")).where(F.col("query_id").isNotNull()).distinct()
    h = history.withColumn("elapsed_hist", F.coalesce(elapsed_seconds("start_time", "end_time"), duration_seconds("elapsed_time"))).withColumn("queue_s", duration_seconds("queue_time")).drop("elapsed_time", "queue_time", "result_cache_hit")
    joined = spine.join(h, "query_id", "left").join(steps, "query_id", "left").join(health, "query_id", "left").join(texts, "query_id", "left")
    out = joined.withColumn("elapsed_s", F.coalesce("elapsed_hist", duration_seconds("duration"))).drop("elapsed_hist")
    return out.withColumn("risk_score", risk_score())


def risk_score() -> Column:
    flag = lambda c, w: F.when(zero(c) > 0, w).otherwise(0)
    return (
        zero("cost_score") + zero("total_spill") / 1e4 + zero("remote_io_ratio") * 20 + zero("max_data_skewness") * 2 + zero("max_time_skewness") * 2 + zero("external_duration_pct") * 10 + flag("has_nested_loop", 15) + flag("dist_both_cnt", 12)
    )


def table_risk(tables: DataFrame) -> DataFrame:
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    x = lambda c: zero(c).cast("double")
    large = x("size_mb") >= 1024
    score = (
        part(x("skew_rows") >= 3, F.least(8 * x("skew_rows"), F.lit(40.0)))
        + part(x("unsorted_pct") >= 20, F.least(x("unsorted_pct") / 2, F.lit(30.0)))
        + part(x("stats_off") >= 10, F.least(x("stats_off") / 2, F.lit(30.0)))
        + part(x("vacuum_sort_benefit") >= 10, F.least(x("vacuum_sort_benefit"), F.lit(20.0)))
        + part(F.upper("diststyle").like("ALL%") & large, F.lit(25.0))
        + part(missing_sortkey("sortkey1") & large, F.lit(20.0))
    )
    key = F.lower(F.concat(F.coalesce("source_db", F.lit("")), F.lit("."), F.coalesce("schema_name", F.lit("")), F.lit("."), F.coalesce("table_name", F.lit(""))))
    return tables.withColumn("table_risk_score", score).withColumn("table_key", key)


def table_references(queries: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables that a statement names: its identifiers, as qualified as they stand, meet the catalogue's names by equality.

    A statement's dotted names are taken apart once and exploded, so the join is a hash join on (name): cost
    follows the mentions, not queries x tables. A qualified mention needs schema.table to be equal (and the
    database too where it names one); a bare mention needs four characters or more. The strongest match stays."""
    text = F.lower(F.coalesce("sql_text", F.lit("")))
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[a-z_][a-z0-9_$]*(?:\.[a-z_][a-z0-9_$]*){0,2}"), F.lit(0)))
    said = queries.select("query_id", F.explode(names).alias("mention")).withColumn("bare", F.substring_index("mention", ".", -1))
    known = tables.select("table_id", "table_key", "table_risk_score", F.lower("table_name").alias("bare"))
    tail = F.concat(F.substring_index(F.substring_index("table_key", ".", -2), ".", 1), F.lit("."), F.col("bare"))
    depth = F.size(F.split("mention", r"\."))
    strength = F.when((depth == 3) & (F.col("mention") == F.col("table_key")), 1).when((depth == 2) & (F.col("mention") == tail), 2).when((depth == 1) & (F.length("bare") >= 4), 3).when((depth == 3) & (F.substring_index("mention", ".", -2) == tail), 2)
    best = W.partitionBy("query_id", "table_id").orderBy("strength", "mention")
    return said.join(known, "bare").withColumn("strength", strength).where("strength is not null").withColumn("n", F.row_number().over(best)).where("n = 1").select("query_id", "table_id", "table_key", "table_risk_score", "strength")


def table_references_contained(queries: DataFrame, tables: DataFrame) -> DataFrame:
    """The containment form: schema.table anywhere in the text, over the whole catalogue.

    A name with one dot can stand only around a dot of the text. For each dot what ends before it, as long as some schema's name, and what
    follows, as long as the longest name of such a schema, are a place. Distinct places meet the schemas and then, cut to each length of their
    names, the names by equality, so cost follows the places and not statements x tables. A statement that holds a name around several dots has it
    once: its first dot counts, and rows alike in id and text keep their number. Names without a dot, which `table_risk` never makes, are
    looked for in the text."""
    named = tables.select("table_id", "table_key", "table_risk_score", F.substring_index("table_key", ".", -2).alias("tail"))
    q = queries.select("query_id", F.lower(F.coalesce("sql_text", F.lit(""))).alias("text"))
    dotted = named.where(F.col("tail").contains("."))
    parts = dotted.select(F.substring_index("tail", ".", 1).alias("before"), F.length(F.substring_index("tail", ".", -1)).alias("size"))
    sizes = parts.groupBy(F.length("before").alias("before")).agg(F.max("size").alias("after")).agg(F.collect_list(F.struct("before", "after")).alias("sizes"))
    left, right = lambda i: F.get("pieces", i - 1), lambda i: F.get("pieces", i)
    place = lambda i: lambda z: F.struct(i.alias("dot"), F.right(left(i), z["before"]).alias("before"), F.left(right(i), z["after"]).alias("rest"))
    around = lambda i: F.transform(F.filter("sizes", lambda z: z["before"] <= F.length(left(i))), place(i))
    cut = q.where(F.col("text").contains(".")).select("query_id", F.unhex(F.md5("text")).alias("digest"), F.split("text", r"\.").alias("pieces")).join(F.broadcast(sizes))
    said = cut.select("query_id", "digest", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("pieces") - 1), around))).alias("p")).select("query_id", "digest", "p.*")
    schemas = parts.groupBy("before").agg(F.collect_set("size").alias("lengths"))
    ways = said.select("before", "rest").distinct().join(schemas, "before").withColumn("size", F.explode("lengths")).where(F.col("size") <= F.length("rest"))
    known = ways.select("before", "rest", F.concat("before", F.lit("."), F.left("rest", F.col("size"))).alias("tail")).join(dotted, "tail")
    out = ["query_id", "table_id", "table_key", "table_risk_score"]
    first = W.partitionBy("query_id", "digest", "tail").orderBy("dot")
    found = said.join(known, ["before", "rest"]).withColumn("n", F.rank().over(first)).where("n = 1")
    bare = q.join(F.broadcast(named.where(~F.col("tail").contains("."))), F.col("text").contains(F.col("tail")))
    return found.select(*out).unionByName(bare.select(*out))


def table_impact(references: DataFrame, slow: DataFrame, fast: bool = False) -> DataFrame:
    """Queries per table and the blast radius; the fast form weighs the mean runtime instead of the sum."""
    s = slow.select("query_id", "elapsed_s", "total_spill", "dist_total_cnt", "bcast_cnt", "max_data_skewness", "risk_score")
    found = references.join(s, "query_id").groupBy("table_id").agg(
        F.max("table_risk_score").alias("risk"),
        F.count("*").alias("slow_query_count"),
        F.sum(zero("elapsed_s")).alias("total_elapsed_s"),
        F.avg(zero("elapsed_s")).alias("avg_elapsed_s"),
        F.max("elapsed_s").alias("max_elapsed_s"),
        F.sum(zero("total_spill")).alias("total_spill"),
        F.sum(F.when(zero("dist_total_cnt") > 0, 1).otherwise(0)).alias("redistribution_count"),
        F.sum(F.when(zero("bcast_cnt") > 0, 1).otherwise(0)).alias("broadcast_count"),
        F.sum(F.when(zero("max_data_skewness") >= 4, 1).otherwise(0)).alias("skewed_count"),
        F.max("risk_score").alias("max_query_risk"),
    )
    time = F.col("avg_elapsed_s" if fast else "total_elapsed_s")
    score = F.col("risk") + F.least(F.col("slow_query_count") * 2.5, F.lit(35.0)) + F.least(time / 3600, F.lit(35.0)) + F.least(F.col("total_spill") / 1e5, F.lit(20.0)) + F.least(F.col("redistribution_count") * 3.0, F.lit(25.0))
    return found.withColumn("blast_radius_score", score)


def table_review(risk: DataFrame, impact: DataFrame, scans: DataFrame) -> DataFrame:
    """Catalogue, impact and scans of each table, with the five attention scores."""
    s = scans.withColumn("table_key", F.concat_ws(".", "table_database", "schema_name", "table_name")).drop("table_database", "schema_name", "table_name")
    joined = risk.join(impact.drop("risk"), "table_id", "left").join(s, "table_key", "left")
    x = lambda c: zero(c).cast("double")
    none = missing_sortkey("sortkey1")
    full = F.least(60 * x("full_scan_query_pct") + F.least(6 * x("non_rrscan_queries"), F.lit(30.0)) + F.least(x("scan_input_rows_m") / 100, F.lit(30.0)), F.lit(120.0))
    dist = F.least(10 * x("redistribution_count") + 8 * x("broadcast_count") + 8 * x("skewed_count") + F.least(6 * x("skew_rows"), F.lit(35.0)), F.lit(120.0))
    sort = F.least(F.when(none & (x("scan_query_count") > 0), 30.0).otherwise(0.0) + 0.7 * x("unsorted_pct") + 0.7 * x("vacuum_sort_benefit") + 35 * (1 - x("rrscan_query_pct")), F.lit(120.0))
    attention = F.least(x("blast_radius_score") + F.least(x("scan_duration_s") / 3600, F.lit(30.0)) + F.least(4 * x("non_rrscan_queries"), F.lit(30.0)) + F.least(x("scan_input_rows_m") / 120, F.lit(25.0)), F.lit(180.0))
    return (
        joined.withColumn("sort_key_usage", F.when(none, 0.0).otherwise(100 * x("rrscan_query_pct")))
        .withColumn("full_scan_score", full)
        .withColumn("distribution_usage_score", dist)
        .withColumn("sort_attention_score", sort)
        .withColumn("table_attention_score", attention)
    )


def fast_review(risk: DataFrame, scans: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Catalogue, scans and step telemetry by table id, without matching statement texts."""
    s = scans.withColumn("table_key", F.concat_ws(".", "table_database", "schema_name", "table_name")).drop("table_database", "schema_name", "table_name")
    joined = risk.join(s, "table_key", "left").join(telemetry, risk["table_id"].cast("string") == telemetry["t_id"], "left").drop("t_id")
    x = lambda c: zero(c).cast("double")
    seen = x("scan_query_count") > 0
    attention = F.least(x("table_risk_score") + F.least(x("scan_duration_s") / 3600, F.lit(30.0)) + F.least(4 * x("non_rrscan_queries"), F.lit(30.0)) + F.least(x("scan_input_rows_m") / 120, F.lit(25.0)), F.lit(180.0))
    return (
        joined.withColumn("slow_query_count", F.greatest(x("telemetry_queries"), x("scan_query_count")))
        .withColumn("avg_scan_s", F.coalesce(ratio("scan_duration_s", "scan_query_count"), F.lit(0.0)))
        .withColumn("distribution_usage_score", F.least(F.least(6 * x("skew_rows"), F.lit(35.0)), F.lit(120.0)))
        .withColumn("sort_attention_score", F.when(seen, F.least(F.when(missing_sortkey("sortkey1"), 30.0).otherwise(0.0) + 0.7 * x("unsorted_pct") + 0.7 * x("vacuum_sort_benefit") + 35 * (1 - x("rrscan_query_pct")), F.lit(120.0))).otherwise(0.0))
        .withColumn("table_attention_score", attention)
    )


def table_telemetry(steps: DataFrame) -> DataFrame:
    """Distinct queries per table and among them the skewed and spilling ones: distinct pairs first, then plain sums."""
    per = steps.where(F.col("table_id").isNotNull()).groupBy(F.col("table_id").cast("string").alias("t_id"), "query_id").agg(F.max(zero("data_skewness")).alias("skew"), F.sum(zero("spill_local") + zero("spill_remote")).alias("spill"))
    return per.groupBy("t_id").agg(F.count("*").alias("telemetry_queries"), F.sum(F.when(F.col("skew") >= 4, 1).otherwise(0)).alias("telemetry_skewed"), F.sum(F.when(F.col("spill") > 0, 1).otherwise(0)).alias("telemetry_spilling"))


def actions(slow: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The action queue with its priority rank.

    Rules and rewrites of queries are judged in one pass, so `slow`, the widest join of all, is made once. Of the rewrites those
    of an impact of 80 or more become actions."""
    t = rules.fired(rules.table_operands(reviewed), rules.TABLE_ACTIONS, ["table_id"]).select(F.lit("table").alias("scope"), F.col("table_id").cast("string").alias("subject"), "rule_id", "severity", F.col("impact_score").alias("action_score"))
    rewrite = F.col("rule_id").isin(*[r.name for r in rules.REWRITE_RULES])
    q = rules.fired(rules.query_operands(slow), rules.QUERY_ACTIONS + rules.REWRITE_RULES, ["query_id"]).where(~rewrite | (F.col("impact_score") >= 80))
    named = F.when(rewrite, F.concat(F.lit("A05_"), F.substring("rule_id", 1, 3))).otherwise(F.col("rule_id"))
    return t.unionByName(q.select(F.lit("query").alias("scope"), F.col("query_id").cast("string").alias("subject"), named.alias("rule_id"), "severity", F.col("impact_score").alias("action_score")))


def ranked_by(found: DataFrame, by: str, score: str, most: int = 200) -> DataFrame:
    """The best `most` rows by score of each `by` (a snapshot, say) with their rank in it.

    The filter stands on the rank itself: so each task keeps its best `most` rows of a snapshot before the exchange, and the
    task that ranks a snapshot sees no more than that from each."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc_nulls_last(score), "subject", "rule_id"))
    return found.withColumn("priority_rank", place).where(F.col("priority_rank") <= most).withColumn("priority_rank", F.col("priority_rank").cast("long"))


def ranked(found: DataFrame, score: str, most: int = 200) -> DataFrame:
    """The best `most` rows by score with their rank; the limit comes first, so the ranking window sees `most` rows."""
    order = [F.desc(score), F.asc("subject"), F.asc("rule_id")]
    return found.orderBy(*order).limit(most).withColumn("priority_rank", F.row_number().over(W.orderBy(*order)).cast("long"))
