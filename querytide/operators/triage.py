"""Verdicts per repeat pattern, physical-design recommendations, maintenance scripts, step and plan findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import bare_column, distkey, missing_key, planned_rows, ratio, split_names, step_category, zero


def suffixes(key: Column) -> Column:
    """A dotted key, its schema.table and its table, most qualified first."""
    parts = F.split(F.lower(key), r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))


def resolved(mentions: DataFrame, catalog: DataFrame) -> DataFrame:
    """mention -> table_id by suffix: only suffixes that one table has count.

    Both sides meet by equality on the mention, whatever its qualification."""
    index = catalog.select("table_id", F.explode(suffixes(F.col("table_key"))).alias("suffix")).groupBy("suffix").agg(F.min("table_id").alias("table_id"), F.size(F.collect_set("table_id")).alias("n")).where("n = 1").drop("n")
    return mentions.join(index, F.lower("mention") == F.col("suffix"), "left").drop("suffix")


def ambiguous_best(mentions: DataFrame, catalog: DataFrame, score: str) -> DataFrame:
    """mention -> the table of the highest score among those that share the suffix."""
    index = catalog.select("table_id", F.col(score).alias("s"), F.explode(suffixes(F.col("table_key"))).alias("suffix")).groupBy("suffix").agg(F.max_by("table_id", F.struct("s", (-F.col("table_id")).alias("t"))).alias("table_id"))
    return mentions.join(index, F.lower("mention") == F.col("suffix"), "left").drop("suffix")


def _plain(c: str) -> Column:
    """An identifier in lower case, without quotes and outer blanks."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), '"', "")))


#: Ways to find a table, best first: written in full, in the query's database, by a schema and table or by a table that one table has.
FULL, IN_DATABASE, ONE_SCHEMA, ONE_NAME = range(4)


def resolved_by_database(mentions: DataFrame, catalog: DataFrame) -> DataFrame:
    """mentions with table_key and found_by: the table that a mention means for a query in its database.

    mentions: mention (table, schema.table or database.schema.table), database_name. catalog: source_db, schema_name,
    table_name, table_key. Where several databases have a schema.table, only the query's own database or a full name
    decides; what stays ambiguous stays null. Each distinct (mention, database) is looked up once: its forms are exploded,
    meet the catalogue's by equality, and the best way wins; within one the more qualified form."""
    # a catalogue is few bytes in its file, so one task would make and sort all of its forms: it is dealt first
    names = catalog.select("source_db", "schema_name", "table_name", "table_key").repartition("source_db", "schema_name", "table_name")
    parts = names.select(*[_plain(c).alias(c) for c in names.columns])
    db, schema, name = F.col("source_db"), F.col("schema_name"), F.col("table_name")
    both = F.when(schema != "", F.concat(schema, F.lit("."), name)).otherwise(name)
    key = F.when(F.col("table_key") != "", F.col("table_key")).otherwise(F.array_join(F.filter(F.array(db, schema, name), lambda x: x != ""), "."))
    form = lambda way, *parts: F.struct(F.lit(way).alias("way"), F.concat_ws("\n", *parts).alias("form"))
    full = F.concat(db, F.lit("."), both)
    index = parts.select(key.alias("table_key"), F.explode(F.array_compact(F.array(
        F.when((db != "") & (both != ""), form(FULL, full)), F.when((db != "") & (both != ""), form(IN_DATABASE, db, both)), F.when(both != "", form(ONE_SCHEMA, both)), F.when(name != "", form(ONE_NAME, name)),
    ))).alias("f")).where("table_key <> ''").select("table_key", "f.*")
    # two owners make a form ambiguous; full names and those of one database are taken as they are
    owners = index.groupBy("way", "form").agg(F.min("table_key").alias("found"), F.max("table_key").alias("last")).where((F.col("way") < ONE_SCHEMA) | (F.col("found") == F.col("last"))).drop("last").hint("merge")  # the file's size says too little of the forms to broadcast them

    asked = mentions.select("mention", "database_name").distinct().withColumn("m", _plain("mention")).withColumn("d", _plain("database_name"))
    parts = F.split("m", r"\.")
    least = F.greatest(F.size(parts) - 2, F.lit(1))
    ends = F.transform(F.sequence(F.lit(1), least), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))  # as written, then without its first parts
    ends = F.when(F.size(parts) > 1, F.concat(ends, F.when(F.size(parts) > 2, F.array(F.array_join(F.slice(parts, -2, 2), "."))).otherwise(F.array().cast("array<string>")), F.slice(parts, -1, 1))).otherwise(parts)
    tries = F.flatten(F.transform(F.array_distinct(ends), lambda e, i: F.array(*[F.struct(F.lit(way).alias("way"), i.alias("place"), f.alias("form")) for way, f in ((FULL, e), (IN_DATABASE, F.when(F.col("d") != "", F.concat_ws("\n", F.col("d"), e))), (ONE_SCHEMA, e), (ONE_NAME, e))])))
    # the last two ways are one tier: there the more qualified form comes first
    rank = F.struct(F.least(F.col("way"), F.lit(ONE_SCHEMA)).alias("tier"), "place", "way")
    best = asked.select("mention", "database_name", F.explode(tries).alias("t")).select("mention", "database_name", "t.*").join(owners, ["way", "form"]).groupBy("mention", "database_name").agg(F.min_by("found", rank).alias("table_key"), F.min_by("way", rank).alias("found_by"))
    b = best.withColumnsRenamed({"mention": "_m", "database_name": "_d"})
    return mentions.join(b, mentions["mention"].eqNullSafe(b["_m"]) & mentions["database_name"].eqNullSafe(b["_d"]), "left").drop("_m", "_d")


QUERY_FLAGS = {
    "wildcard": "wildcard_count > 0",
    "join_without_predicate": "join_count > 0 and predicate_count = 0",
    "spill": "avg_total_spill > 0",
    "nested_loop": "avg_has_nested_loop >= 0.3",
    "redistribution": "avg_dist_both_cnt >= 0.5",
    "broadcast": "avg_bcast_cnt >= 0.5",
    "remote_io": "avg_remote_io_ratio >= 0.3",
    "skew": "greatest(avg_max_data_skewness, avg_max_time_skewness) >= 4",
    "low_selectivity": "avg_selectivity_ratio >= 0.9 and predicate_count = 0",
}
TABLE_FLAGS = {
    "no_sortkey": "no_sortkey and size_mb >= 100",
    "unsorted": "unsorted_pct >= 20",
    "stale_stats": "stats_off >= 10",
    "weak_rrscan": "rrscan_query_pct <= 0.5 and scan_query_count >= 3",
    "full_scans": "full_scan_query_pct >= 0.5",
    "even_or_all": "(upper(diststyle) like 'EVEN%' or upper(diststyle) like 'ALL%') and size_mb >= 1000",
    "skew": "skew_rows >= 4",
}


def _flags(catalogue: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in catalogue.items()]))


def group_flags(groups: DataFrame) -> DataFrame:
    return groups.withColumn("query_flags", _flags(QUERY_FLAGS))


def table_flags(review: DataFrame) -> DataFrame:
    """Expects the review columns; nulls count as no evidence."""
    names = [c for c in ("size_mb", "unsorted_pct", "stats_off", "full_scan_query_pct", "scan_query_count", "skew_rows") if c in review.columns]
    ready = review.withColumns({c: zero(c) for c in names}).withColumn("rrscan_query_pct", F.coalesce("rrscan_query_pct", F.lit(1.0))).withColumn("no_sortkey", missing_key("sortkey1"))
    return ready.withColumn("table_flags", _flags(TABLE_FLAGS))


def verdicts(groups: DataFrame, review: DataFrame) -> DataFrame:
    """Verdict, coverage and priority per pattern. groups: repeat_group_id, sql_tables and the averages of QUERY_FLAGS."""
    flagged = group_flags(groups)
    mentions = groups.select("repeat_group_id", F.explode_outer(split_names("sql_tables")).alias("mention"))
    t = table_flags(review).select("table_id", "table_key", F.size("table_flags").alias("flags"))
    hit = resolved(mentions, t).join(t.drop("table_key"), "table_id", "left")
    per = hit.groupBy("repeat_group_id").agg(F.count("mention").alias("named"), F.count("table_id").alias("matched"), F.sum(zero("flags")).alias("table_flag_count"))
    out = flagged.join(per, "repeat_group_id", "left").withColumn("query_flag_count", F.size("query_flags").cast("long")).withColumn("table_flag_count", zero("table_flag_count"))
    q, t_ = F.col("query_flag_count") > 0, F.col("table_flag_count") > 0
    verdict = F.when(q & t_, "FIX BOTH").when(q, "FIX QUERY").when(t_, "FIX TABLES").otherwise("MONITOR")
    coverage = F.when(zero("named") == 0, "none").when(F.col("matched") == F.col("named"), "complete").when(F.col("matched") > 0, "partial").otherwise("none")
    spill = F.when(F.col("avg_total_spill") > 0, 1.25).otherwise(1.0)
    score = (F.col("total_runtime_s") + 10 * F.sqrt(F.col("query_count").cast("double"))) * spill + F.least(F.col("total_input_rows") / 1e7, F.lit(50.0))
    return out.withColumn("verdict", verdict).withColumn("coverage", coverage).withColumn("triage_priority_score", score)


def structural_stats(groups: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per table and column: patterns and runtime by use (filter or join)."""
    mention = groups.select("repeat_group_id", "total_runtime_s", "query_count", "sql_filter_columns", "sql_join_columns", F.explode(split_names("sql_tables")).alias("mention"))
    hit = resolved(mention, catalog).where(F.col("table_id").isNotNull())
    use = lambda c, kind: hit.select("table_id", "repeat_group_id", "total_runtime_s", F.lit(kind).alias("use"), F.explode(F.array_distinct(F.transform(split_names(c), bare_column))).alias("column"))
    both = use("sql_filter_columns", "filter").unionByName(use("sql_join_columns", "join"))
    return both.groupBy("table_id", "column", "use").agg(F.size(F.collect_set("repeat_group_id")).cast("long").alias("patterns"), F.sum("total_runtime_s").alias("runtime_s"))


def best_columns(stats: DataFrame, use: str, k: int = 1) -> DataFrame:
    order = W.partitionBy("table_id").orderBy(F.desc("runtime_s"), F.desc("patterns"), "column")
    return stats.where(F.col("use") == use).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def sortkey_advice(stats: DataFrame, review: DataFrame) -> DataFrame:
    best = best_columns(stats, "filter").select("table_id", F.col("column").alias("sort_column"), "patterns", "runtime_s")
    x = lambda c: zero(c).cast("double")
    rr = F.coalesce("rrscan_query_pct", F.lit(0.0))
    pressure = x("sort_attention_score") + 0.5 * x("full_scan_score") + F.least(x("runtime_s") / 3600, F.lit(35.0)) + F.least(5 * x("patterns"), F.lit(25.0)) + 25 * F.greatest(F.lit(0.0), 1 - rr) + 20 * x("full_scan_query_pct")
    out = review.join(best, "table_id").withColumn("missing", missing_key("sortkey1")).withColumn("pressure", pressure)
    fits = (x("size_mb") >= 100) & ((x("scan_query_count") >= 1) | (F.col("patterns") >= 2)) & (F.lower(F.coalesce("sortkey1", F.lit(""))) != F.col("sort_column")) & ((F.col("pressure") >= 45) | F.col("missing"))
    return out.where(fits).select("table_id", F.lit("SORTKEY").alias("kind"), F.col("sort_column").alias("column"), "pressure", F.when((F.col("pressure") >= 115) | F.col("missing"), "crit").otherwise("warn").alias("severity"))


def distkey_advice(stats: DataFrame, review: DataFrame) -> DataFrame:
    best = best_columns(stats, "join").select("table_id", F.col("column").alias("dist_column"), "patterns", "runtime_s")
    x = lambda c: zero(c).cast("double")
    pressure = x("distribution_usage_score") + F.least(x("runtime_s") / 3600, F.lit(40.0)) + F.least(6 * x("patterns"), F.lit(36.0)) + F.least(4 * x("redistribution_count"), F.lit(35.0)) + F.least(3 * x("broadcast_count"), F.lit(25.0)) + F.when(x("size_mb") >= 1024, 20.0).otherwise(0.0)
    out = review.join(best, "table_id").withColumn("pressure", pressure)
    key = out.where((F.col("pressure") >= 45) & ~F.coalesce(distkey("diststyle") == F.col("dist_column"), F.lit(False))).select("table_id", F.lit("DISTKEY").alias("kind"), F.col("dist_column").alias("column"), "pressure", F.when((F.col("pressure") >= 120) | (x("redistribution_count") >= 5), "crit").otherwise("warn").alias("severity"))
    whole = out.where(F.upper("diststyle").like("ALL%") & (x("size_mb") >= 2048)).select("table_id", F.lit("ALL_REVIEW").alias("kind"), F.lit("").alias("column"), (F.least(F.col("pressure"), F.lit(80.0)) + F.least(x("size_mb") / 1024, F.lit(20.0))).alias("pressure"), F.lit("warn").alias("severity"))
    skew = review.where(x("skew_rows") >= 4).select("table_id", F.lit("SKEW_REVIEW").alias("kind"), F.lit("").alias("column"), (85 + F.least(6 * x("skew_rows"), F.lit(45.0))).alias("pressure"), F.lit("warn").alias("severity"))
    return key.unionByName(whole).unionByName(skew)


def scenarios(review: DataFrame, demand: DataFrame) -> DataFrame:
    """Sort-key fit (0, 30, 70, 100), distribution fit and maintenance debt of each table."""
    best = W.partitionBy("table_name").orderBy(F.desc("demand"), "column")
    top = demand.withColumn("n", F.row_number().over(best)).where("n <= 3").groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("n", "column"))).alias("o")).withColumn("wanted", F.transform("o", lambda x: x["column"]))
    out = review.withColumn("name", F.lower("table_name")).join(top.select(F.col("table_name").alias("name"), "wanted"), "name", "left")
    sort = F.lower(F.coalesce("sortkey1", F.lit("")))
    fit = F.when(F.col("wanted").isNull(), None).when(missing_key("sortkey1"), 0).when(F.element_at("wanted", 1) == sort, 100).when(F.array_contains("wanted", sort), 70).otherwise(30)
    debt = F.least(zero("unsorted_pct") / 2 + zero("stats_off") + zero("vacuum_sort_benefit"), F.lit(100))
    dist = F.when(zero("skew_rows") >= 4, 0).when(F.upper("diststyle").like("KEY%"), 100).when(F.upper("diststyle").like("ALL%") & (zero("size_mb") >= 1024), 30).otherwise(70)
    return out.withColumn("sort_key_fit", fit.cast("long")).withColumn("distribution_fit", dist.cast("long")).withColumn("maintenance_debt", debt.cast("double"))


def fix_script(review: DataFrame, advice: DataFrame) -> DataFrame:
    """Script lines (section, ord, line): maintenance can run, design changes are comments."""
    key = F.col("table_key")
    upkeep = review.select("table_id", "table_key", F.explode(F.array_compact(F.array(
        F.when(zero("stats_off") >= 10, F.struct(F.lit(1).alias("step"), F.concat(F.lit("ANALYZE "), key, F.lit(";")).alias("line"))),
        F.when((zero("unsorted_pct") >= 20) | (zero("vacuum_sort_benefit") >= 10), F.struct(F.lit(2).alias("step"), F.concat(F.lit("VACUUM SORT ONLY "), key, F.lit(";")).alias("line"))),
    ))).alias("s")).select(F.lit("maintenance").alias("section"), F.lit(0.0).alias("weight"), "table_id", "s.step", "s.line")
    text = F.when(F.col("kind") == "SORTKEY", F.concat(F.lit("-- ALTER TABLE "), key, F.lit(" ALTER SORTKEY ("), F.col("column"), F.lit(");"))).when(F.col("kind") == "DISTKEY", F.concat(F.lit("-- ALTER TABLE "), key, F.lit(" ALTER DISTKEY "), F.col("column"), F.lit(";"))).otherwise(F.concat(F.lit("-- review "), F.lower("kind"), F.lit(" of "), key))
    design = advice.join(review.select("table_id", "table_key"), "table_id").select(F.lit("design").alias("section"), F.col("pressure").alias("weight"), "table_id", F.when(F.col("kind") == "SORTKEY", 1).when(F.col("kind") == "DISTKEY", 2).otherwise(3).alias("step"), text.alias("line"))
    return upkeep.unionByName(design)


def script_text(lines: DataFrame) -> str:
    """The script itself: every line, the most pressing first; one partition at a time comes to the driver."""
    rows = lines.orderBy(F.desc("section"), F.desc("weight"), "table_id", "step")
    out, section = [], None
    for r in rows.toLocalIterator():
        if r["section"] != section:
            section = r["section"]
            out += ["", f"-- {section}"]
        out.append(r["line"])
    return "\n".join(out).strip() + "\n"


# One query's steps -----------------------------------------------------------------------------
def located(steps: DataFrame, tables: DataFrame) -> DataFrame:
    """steps whose table_id is not known, with the table of their schema_name and table_name, else of the bare name; of several the smallest id.

    Different names are looked up once each, whatever their steps."""
    full = lambda s, t: F.btrim(F.lower(F.concat_ws(".", F.coalesce(s, F.lit("")), t)), F.lit("."))
    names = F.array_distinct(F.array(full(F.col("schema_name"), F.col("table_name")), F.lower("table_name")))
    index = tables.where("table_name <> ''").select("table_id", F.explode(names).alias("form")).groupBy("form").agg(F.min("table_id").alias("id"))
    known = tables.select(F.col("table_id").alias("_known")).distinct()
    s = steps.join(known, F.col("table_id") == F.col("_known"), "left")
    asked = s.where("_known is null and table_name <> ''").select(F.col("schema_name").alias("_schema"), F.col("table_name").alias("_table")).distinct()
    forms = F.array(full(F.col("_schema"), F.col("_table")), F.lower("_table"))
    found = asked.select("_schema", "_table", F.posexplode(forms).alias("place", "form")).join(index, "form").groupBy("_schema", "_table").agg(F.min_by("id", "place").alias("_found"))
    both = s.join(found, F.col("schema_name").eqNullSafe(F.col("_schema")) & (F.col("table_name") == F.col("_table")) & F.col("_known").isNull(), "left")
    return both.withColumn("table_id", F.coalesce("_known", "_found", "table_id")).drop("_known", "_schema", "_table", "_found")


def enriched_steps(steps: DataFrame, tables: DataFrame) -> DataFrame:
    """Steps with category, share of runtime, previous step of the stream and segment, and table figures; where steps name their tables, by name too."""
    if {"schema_name", "table_name"} <= {*steps.columns}:
        steps = located(steps, tables)
    flow = W.partitionBy("query_id", "stream_id", "segment_id").orderBy("step_id", F.col("table_id").asc_nulls_last(), F.desc("duration"))
    total = F.sum("duration").over(W.partitionBy("query_id"))
    s = steps.withColumn("category", step_category("step_name")).withColumn("pct_runtime", ratio(100.0 * F.col("duration"), total)).withColumn("previous_step", F.lag("step_name").over(flow)).withColumn("previous_table", F.lag("table_id").over(flow)).withColumn("previous_pct", F.lag("pct_runtime").over(flow))
    return s.join(tables.select("table_id", "diststyle", "sortkey1", "unsorted_pct", "stats_off", "skew_rows", "tbl_rows"), "table_id", "left")


def step_findings(steps: DataFrame) -> DataFrame:
    """Findings of enriched steps, by query. Redistribution is judged by its share of a query's whole time, once for each query."""
    moving = F.col("category") == "redistribute"
    share = steps.groupBy("query_id").agg(ratio(F.sum(F.when(moving, F.col("duration"))), F.sum("duration")).alias("share"), F.max_by(F.struct("stream_id", "segment_id", "step_id"), F.when(moving, F.struct(zero("duration").alias("d"), (-F.col("step_id")).alias("s")))).alias("worst"))
    share = share.where(F.col("share") >= 0.15).select("query_id", "worst.*", F.lit("REDISTRIBUTION").alias("finding"), F.when(F.col("share") > 0.4, "crit").otherwise("warn").alias("severity"), F.col("share").alias("impact"))
    same = F.col("previous_table").eqNullSafe(F.col("table_id"))
    checks = [
        ("DISTKEY_MISMATCH", (F.col("category") == "join") & F.upper(F.coalesce("diststyle", F.lit(""))).contains("KEY") & (step_category("previous_step") == "redistribute") & same, F.lit(True), (zero("pct_runtime") + zero("previous_pct")) / 100),
        ("UNSORTED_SCAN", (F.col("category") == "scan") & (zero("unsorted_pct") >= 20) & (zero("input_rows") > 1_000_000), zero("unsorted_pct") >= 50, zero("unsorted_pct").cast("double")),
        ("STALE_STATS", (zero("stats_off") >= 10), zero("stats_off") >= 25, zero("stats_off").cast("double")),
        ("SKEW", zero("data_skewness") >= 3, zero("data_skewness") >= 5, 10.0 * zero("data_skewness")),
        ("REMOTE_SPILL", zero("spill_remote") > 0, F.lit(True), F.least(zero("spill_remote") / 100, F.lit(100.0))),
        ("LOCAL_SPILL", zero("spill_local") > 1000, F.lit(False), F.least(zero("spill_local") / 1000, F.lit(60.0))),
        ("ALERT", F.coalesce("alert", F.lit("")) != "", F.lit(False), F.lit(40.0)),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("finding"), F.when(crit, "crit").otherwise("warn").alias("severity"), m.cast("double").alias("impact"))) for k, c, crit, m in checks]))
    each = steps.select("query_id", "stream_id", "segment_id", "step_id", F.explode(found).alias("f")).select("query_id", "stream_id", "segment_id", "step_id", "f.*")
    return each.unionByName(share)


# Plans -----------------------------------------------------------------------------------------
def plan_evidence(explain: DataFrame, detail: DataFrame) -> DataFrame:
    """Plan nodes with their measured rows, bytes and spill (full outer by node)."""
    e = explain.select("query_id", "plan_node_id", "plan_node", "plan_info", planned_rows("plan_node").alias("planned_rows"))
    d = detail.groupBy("query_id", "plan_node_id").agg(F.sum("output_rows").alias("output_rows"), F.sum("input_bytes").alias("input_bytes"), F.sum(zero("spill_local") + zero("spill_remote")).alias("spill_blocks"), F.max("data_skewness").alias("skew"))
    return e.join(d, ["query_id", "plan_node_id"], "full_outer")


def plan_findings(evidence: DataFrame, block_bytes: int = 1 << 20) -> DataFrame:
    """Broadcasts, spills, wrong estimates, wide scans and skew."""
    node, rows = F.lower(F.coalesce("plan_node", F.lit(""))), zero("output_rows")
    spill = zero("spill_blocks") * block_bytes
    estimate = F.greatest(ratio(rows, "planned_rows"), ratio("planned_rows", rows))
    checks = [
        ("BROADCAST", node.contains("bcast") & (rows >= 1_000_000), F.when(rows >= 100_000_000, "crit").otherwise("warn"), rows.cast("double")),
        ("SPILL", spill >= 1_000_000_000, F.when(spill >= 10_000_000_000, "high").otherwise("warn"), spill.cast("double")),
        ("ESTIMATE_ERROR", estimate >= 100, F.lit("warn"), estimate),
        ("WIDE_SCAN", node.contains("scan") & (zero("input_bytes") >= 50_000_000_000) & (zero("input_bytes") / F.greatest(rows, F.lit(1)) > 10_000), F.lit("warn"), zero("input_bytes").cast("double")),
        ("SKEW", zero("skew") >= 4, F.lit("warn"), zero("skew").cast("double")),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("finding"), s.alias("severity"), m.alias("metric"))) for k, c, s, m in checks]))
    return evidence.select("query_id", "plan_node_id", F.explode(found).alias("f")).select("query_id", "plan_node_id", "f.*")


LARGE_ROWS, LARGE_MB = 1_000_000, 1024


def unkeyed_findings(tables: DataFrame, referenced: DataFrame | None = None) -> DataFrame:
    """Large tables (among those referenced: one column table_id) without a distribution or sort key, and the skewed ones of them."""
    if referenced is not None:
        tables = tables.join(referenced.select("table_id").distinct(), "table_id", "left_semi")
    no_dist, no_sort = distkey("diststyle").isNull(), missing_key("sortkey1")
    large = tables.where((no_dist | no_sort) & ((zero("tbl_rows") >= LARGE_ROWS) | (zero("size_mb") >= LARGE_MB)))
    found = F.array_compact(F.array(F.struct(F.lit("TABLE_UNKEYED").alias("finding"), F.when(no_dist, "high").otherwise("medium").alias("severity")), F.when(zero("skew_rows") >= 4, F.struct(F.lit("TABLE_SKEW").alias("finding"), F.lit("high").alias("severity")))))
    return large.select("table_id", F.explode(found).alias("f")).select("table_id", "f.*")


def ranked_findings(found: DataFrame, ties: list[str], most: int = 200) -> DataFrame:
    """Findings by tier, severity and whether they have evidence, best first, with their place."""
    out = found.withColumn("weight", F.when(F.col("severity") == "crit", 3).when(F.col("severity") == "high", 2).otherwise(1))
    order = [F.asc("tier"), F.desc("weight"), F.desc("evidence"), *[F.asc(c) for c in ties]]
    return out.orderBy(*order).limit(most).withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long"))


def health(review: DataFrame) -> DataFrame:
    """Heat-map health: distribution, sorting and statistics of each table, and the worst of the first two."""
    dist = F.when(zero("skew_rows") >= 4, 2).when(F.upper("diststyle").like("EVEN%") | F.upper("diststyle").like("AUTO%"), 1).otherwise(0)
    sort = F.when(missing_key("sortkey1") | (zero("unsorted_pct") > 90), 2).when(zero("unsorted_pct") >= 50, 1).otherwise(0)
    return review.select("table_id", dist.cast("int").alias("dist_health"), sort.cast("int").alias("sort_health"), F.greatest(dist, sort).cast("int").alias("health"), (100 - zero("stats_off") <= 60).alias("stats_alert"))


def category(groups: DataFrame) -> Column:
    """sproc, utility, spectrum or plain."""
    return F.when(F.col("repeat_kind") == "proc", "sproc").when(F.upper("query_type").isin("UTILITY", "DDL", "VACUUM", "ANALYZE", "COPY", "UNLOAD"), "utility").when(zero("avg_s3_scan_cnt") > 0, "spectrum").otherwise("plain")


#: Categories that tell what tables a group touches; the others are its one kind.
MIXES = ("mixed", "view")


def _of_categories(groups: DataFrame, wanted: set[str]) -> Column:
    """Whether a group is of any of the wanted categories: its kind, or mixed, or view."""
    has = lambda c: F.col(c) if c in groups.columns else F.lit(None)
    kinds = [k for k in wanted if k not in MIXES]
    out = category(groups).isin(kinds) if kinds else F.lit(False)
    if "mixed" in wanted:
        out = out | (F.lower(F.trim(F.coalesce(has("mixed_query_class").cast("string"), F.lit("")))) == "mixed")
    if "view" in wanted:
        out = out | F.coalesce(has("uses_view").cast("boolean"), F.lit(False))
    return out


def chart(groups: DataFrame, scenario: str = "overview", most: int = 200, categories: set[str] | None = None, least_s: float = 0.0, metric: str = "total_input_rows", positive: bool = True) -> DataFrame:
    """The chart's rows: of the wanted categories, runtimes and metric, scored by scenario, best first. The median is exact.

    Scenarios weigh the mean runtime: light ones by how few rows a run reads, heavy ones by spill, by moved data that gives
    little output, by waiting, or by skew and remote reads."""
    x = lambda c: zero(c).cast("double") if c in groups.columns else F.lit(0.0)
    runs = F.greatest(x("query_count"), F.lit(1.0))
    per = groups.where(_of_categories(groups, categories)) if categories else groups
    per = per.withColumns({"runtime": x("total_runtime_s") / runs, "rows_per_run": x("total_input_rows") / runs, "metric_per_run": x(metric) / runs})
    runtime, rows, queue = F.col("runtime"), F.col("rows_per_run"), x("total_queue_s") / runs
    log = lambda c: F.log10(1 + F.greatest(c, F.lit(0.0)))
    spill = x("total_spill_blocks") / runs if "total_spill_blocks" in groups.columns else x("avg_total_spill")
    moved, read = x("avg_dist_both_cnt") + x("avg_bcast_cnt"), x("total_input_bytes") / runs
    share = x("total_output_rows") / runs / F.when(rows > 0, rows).otherwise(1.0)
    skew, remote, s3 = F.greatest(x("avg_max_data_skewness"), x("avg_max_time_skewness")), x("avg_remote_io_ratio"), x("avg_s3_scan_cnt")
    kept, score = F.lit(True), runtime
    if scenario == "slow_light":
        middle = F.coalesce(per.where(rows > 0).agg(F.median("rows_per_run")).scalar(), F.lit(1_000_000.0))
        kept, score = (runtime >= 10) & (rows <= middle) & (spill <= 0), runtime / (1 + log(rows))
    elif scenario == "spill_slow":
        kept, score = spill > 0, runtime * (1 + log(spill))
    elif scenario == "io_shuffle":
        kept, score = (moved > 0) & (read > 0) & (share <= 0.25), runtime * (1 + moved) * (1 + log(read)) * (2 - F.greatest(F.lit(0.0), F.least(share, F.lit(1.0))))
    elif scenario == "queue_bound":
        kept, score = queue > 0, queue * (1 + queue / F.greatest(runtime, F.lit(0.001)))
    elif scenario == "skew_remote":
        kept, score = (skew >= 4) | (remote >= 0.3) | (s3 > 0), runtime * (1 + F.greatest(skew, F.lit(0.0)) + 10 * F.greatest(remote, F.lit(0.0)) + s3)
    found = per.where(kept & (runtime >= least_s)).withColumn("chart_score", score)
    if positive:  # nothing to place on a logarithmic axis
        found = found.where("metric_per_run > 0")
    return found.orderBy(F.desc("chart_score"), F.desc("runtime"), F.desc("total_runtime_s"), "repeat_group_id").limit(most)


def issue_matrix(slow: DataFrame, found: DataFrame, most: int = 40) -> DataFrame:
    """The riskiest queries against rule families: 3 for impact 80 and above, 2 for 50, else 1."""
    top = slow.orderBy(F.desc_nulls_last("risk_score"), "query_id").limit(most).select(F.col("query_id").cast("string").alias("subject"))
    level = F.when(F.col("impact_score") >= 80, 3).when(F.col("impact_score") >= 50, 2).otherwise(1)
    return found.where("scope = 'query'").join(F.broadcast(top), "subject").groupBy("subject", F.substring("rule_id", 1, 24).alias("family")).agg(F.max(level).cast("long").alias("level"))
