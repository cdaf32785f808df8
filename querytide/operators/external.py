"""External (object-store) tables: matching activity to the catalogue, rollups, assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import ratio, zero

GB = 1e9


def catalog_keyed(catalog: DataFrame) -> DataFrame:
    """Catalogue rows (ext_id, schema_name, table_name, location, …) with their dotted key."""
    return catalog.withColumn("external_table_key", F.lower(F.concat_ws(".", "schema_name", "table_name")))


def prefixes(location: Column) -> Column:
    """A location and its parent folders, longest first."""
    parts = F.split(F.regexp_replace(location, "/+$", ""), "/")
    return F.transform(F.sequence(F.size(parts), F.lit(3), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def matched(segments: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each segment with its best catalogue entry: full name, then bare name, then the longest location prefix.

    The OR of three conditions would be a nested loop; here names and places explode into ranked keys (at most two names and
    the place's own parent folders) and meet the catalogue's keys by equality. The best rank wins. Segments with the same name
    and place have the same entry, so each such pair is matched once and its entry joined back."""
    c = catalog_keyed(catalog)
    keys = c.select("ext_id", F.explode(F.array(
        F.struct(F.lit(1).alias("class"), F.col("external_table_key").alias("key")),
        F.struct(F.lit(2).alias("class"), F.lower("table_name").alias("key")),
        F.struct(F.lit(3).alias("class"), F.regexp_replace("location", "/+$", "").alias("key")),
    )).alias("k")).select("ext_id", "k.*")
    s = segments.withColumns({"_name": F.lower(F.coalesce("table_name", F.lit(""))), "_place": F.coalesce("file_location", F.lit(""))})
    name = F.col("_name")
    wanted = F.concat(
        F.array(F.struct(F.lit(1).alias("class"), name.alias("key"), F.lit(0).alias("rank")), F.struct(F.lit(2).alias("class"), F.substring_index(name, ".", -1).alias("key"), F.lit(1).alias("rank"))),
        F.transform(prefixes(F.col("_place")), lambda p, i: F.struct(F.lit(3).alias("class"), p.alias("key"), (i + 2).alias("rank"))),
    )
    tried = s.select("_name", "_place").distinct().select("_name", "_place", F.explode(wanted).alias("w")).select("_name", "_place", "w.*").where("key <> ''")
    best = tried.join(keys, ["class", "key"]).groupBy("_name", "_place").agg(F.min_by("ext_id", F.struct("rank", "ext_id")).alias("ext_id"), F.min("rank").alias("match_rank"))
    return s.join(best, ["_name", "_place"], "left").drop("_name", "_place")


def pruning_pct(total: Column, kept: Column) -> Column:
    return F.when(total > 0, 100.0 * (total - kept) / total)


def pruning_band(pct: Column) -> Column:
    return F.when(pct.isNull(), "unknown").when(pct >= 90, "excellent").when(pct >= 50, "partial").when(pct >= 10, "weak").otherwise("none")


WARNINGS = (("PARTITION", "%partition%"), ("SMALL_FILES", "%small file%"), ("ACCESS", "%denied%"), ("FORMAT", "%format%"))


def warning_category(c: Column) -> Column:
    out = F.when(c.isNull() | (F.trim(c) == ""), F.lit(None).cast("string")).otherwise("OTHER")
    for name, pattern in reversed(WARNINGS):
        out = F.when(c.ilike(pattern), name).otherwise(out)
    return out


def activity(found: DataFrame) -> DataFrame:
    """Rollup of matched segments per external table."""
    x = lambda c: F.sum(zero(c))
    category = warning_category(F.col("warning"))
    per = found.where(F.col("ext_id").isNotNull()).groupBy("ext_id", "query_id").agg(
        F.count("*").alias("segments"), x("total_partitions").alias("total_partitions"), x("qualified_partitions").alias("qualified_partitions"), x("scanned_files").alias("scanned_files"), x("returned_rows").alias("returned_rows"), x("returned_bytes").alias("returned_bytes"),
        x("duration").alias("duration"), F.max(zero("s3list_time")).alias("s3list_time"), F.sum(F.when(category.isNotNull(), 1).otherwise(0)).alias("warnings"), F.sum(F.when(category == "PARTITION", 1).otherwise(0)).alias("partition_warnings"),
    )
    return per.groupBy("ext_id").agg(
        F.count("*").alias("query_count"), F.sum("segments").alias("segment_count"), F.sum("total_partitions").alias("total_partitions"), F.sum("qualified_partitions").alias("qualified_partitions"), F.sum("scanned_files").alias("scanned_files"), F.sum("returned_rows").alias("returned_rows"),
        (F.sum("returned_bytes") / GB).alias("scan_gb"), (F.sum("duration") / 1e6).alias("external_duration_s"), F.max("s3list_time").alias("s3list_time_ms"), F.sum("warnings").alias("warning_count"), F.sum("partition_warnings").alias("partition_warnings"),
    )


def external_tables(catalog: DataFrame, rolled: DataFrame) -> DataFrame:
    """The catalogue with activity, ratios and bands (tables without activity stay)."""
    out = catalog_keyed(catalog).join(rolled, "ext_id", "left")
    pct = pruning_pct(F.col("total_partitions").cast("double"), F.col("qualified_partitions"))
    return out.withColumn("partition_pruning_pct", pct).withColumn("pruning_band", pruning_band(F.col("partition_pruning_pct"))).withColumn("avg_files_per_segment", ratio("scanned_files", "segment_count")).withColumn("files_per_query", ratio("scanned_files", "query_count"))


# The titles of the recommendations; equal weights are told in their order.
TITLES = {
    "COLUMNAR": "Convert the S3 dataset to a columnar format",
    "PRUNE": "Make queries prune the existing partitions",
    "REDESIGN": "Redesign or verify the partition strategy",
    "TIGHTEN": "Tighten partition predicates",
    "EVALUATE": "Evaluate a workload-aligned partition key",
    "COMPACT": "Compact and rebalance the S3 files",
    "SIZING": "Review S3 file sizing and fan-out",
    "EARLIER": "Push selective work earlier",
    "PUSHDOWN": "Review predicate and column pushdown",
    "STAGE": "Materialize or stage the repeated external working set",
    "STATISTICS": "Verify external-table statistics",
    "QUALITY": "Resolve recurring Spectrum warnings or data errors",
    "LOCAL": "Review a local distributed stage for downstream work",
}


def _issues(tables: DataFrame) -> Column:
    """array<struct<code, weight, title>> of the rules that hold; of a family's rules the first."""
    x = lambda c: zero(c).cast("double") if c in tables.columns else F.lit(0.0)
    gb, runs, keyed = x("scan_gb"), x("query_count"), (x("partition_keys") > 0)
    many, pruned = x("total_partitions") > 1, F.coalesce(F.col("partition_pruning_pct"), F.lit(-1.0))
    listing, files = x("s3list_time_ms") / F.greatest(runs, F.lit(1.0)), x("avg_files_per_segment")
    matched_steps, filtered = x("output_metric_match_count") > 0, x("row_filter_efficiency_pct")
    columnar = F.regexp_replace(F.upper(F.coalesce("input_format", F.lit(""))), "[^A-Z0-9]", "").rlike("PARQUET|ORC|RCFILE")
    counted = F.coalesce("parameters", F.lit("")).rlike("(?i)(?:^|[^a-z])numrows(?:[^a-z]|$)")
    heavy = F.when(gb >= 10, 30).otherwise(20)
    families = [
        [("COLUMNAR_FORMAT", "COLUMNAR", ~columnar & (F.coalesce("input_format", F.lit("")) != ""), F.lit(30))],
        [
            ("PARTITION_PREDICATE", "PRUNE", many & (pruned < 50) & keyed, heavy),
            ("PARTITION_DESIGN", "REDESIGN", many & (pruned < 50), heavy),
            ("PARTITION_PREDICATE", "TIGHTEN", many & (pruned < 90) & (gb >= 10), F.lit(15)),
            ("PARTITION_DESIGN", "EVALUATE", ~many & ~keyed & (gb >= 25), F.lit(20)),
        ],
        [("FILE_LAYOUT", "COMPACT", (files > 1000) | (x("files_per_query") > 5000) | (listing > 2000), F.lit(25)), ("FILE_LAYOUT", "SIZING", (files > 100) | (listing > 500), F.lit(15))],
        [("PUSHDOWN", "EARLIER", matched_steps & (filtered >= 90) & (gb >= 25), F.lit(20)), ("PUSHDOWN", "PUSHDOWN", matched_steps & (filtered >= 50) & (gb >= 100), F.lit(12))],
        [("MATERIALIZE_OR_STAGE", "STAGE", (runs >= 10) & ((gb >= 100) | (x("external_duration_s") >= 3600)), F.when((runs >= 25) | (gb >= 500), 25).otherwise(18))],
        [("EXTERNAL_STATISTICS", "STATISTICS", ~counted & (runs >= 5) & (gb >= 10), F.lit(12))],
        [("DATA_QUALITY", "QUALITY", (x("warning_count") > 5) | (x("error_count") > 0), F.when(x("error_count") > 0, 20).otherwise(12))],
        [("LOCAL_STAGE_DESIGN", "LOCAL", (x("external_spill_blocks") > 0) & (runs >= 5), F.lit(12))],
    ]
    found = []
    for rules in families:
        first = F.lit(None)
        for code, title, when, weight in reversed(rules):
            first = F.when(when, F.struct(F.lit(code).alias("code"), weight.cast("int").alias("weight"), F.lit(TITLES[title]).alias("title"))).otherwise(first)
        found.append(first)
    return F.array_compact(F.array(*found))


def assessed(tables: DataFrame) -> DataFrame:
    """Issues, score, priority and confidence of each external table with activity."""
    active = tables.where((F.col("query_count") > 0) & (F.col("scan_gb") > 0))
    before = lambda a, b: F.when(a["weight"] != b["weight"], b["weight"] - a["weight"]).when(a["title"] < b["title"], -1).when(a["title"] > b["title"], 1).otherwise(0)
    out = active.withColumn("issues", F.array_sort(_issues(active), before)).withColumn("score", F.least(F.aggregate("issues", F.lit(0), lambda a, i: a + i["weight"]), F.lit(100)))
    score, steps = F.col("score"), zero("output_metric_match_count") if "output_metric_match_count" in active.columns else F.lit(0)
    priority = F.when(score >= 70, "critical").when(score >= 45, "high").when(score >= 20, "medium").when(score > 0, "low").otherwise("none")
    return out.withColumn("priority", priority).withColumn("confidence", F.when((F.col("query_count") >= 5) & (steps > 0), "high").otherwise("medium"))


def step_outputs(segments: DataFrame, steps: DataFrame) -> DataFrame:
    """Segments with the rows and spill of their steps: the step of the same query and segment whose name is the segment's or a dotted end of it, or the other way round.

    steps: query_id, segment_id, step_table, output_rows, spill_blocks. Both sides meet by query and segment, so the
    comparison of names is a residual condition on few rows."""
    a, b = F.lower(F.coalesce("table_name", F.lit(""))), F.lower("step_table")
    fits = (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))
    s = steps.withColumnsRenamed({"query_id": "_q", "segment_id": "_s"})
    joined = segments.join(s, (F.col("query_id") == F.col("_q")) & (F.col("segment_id") == F.col("_s")) & (a != "") & fits, "left")
    return joined.drop("_q", "_s", "step_table")


def output_rollup(found: DataFrame) -> DataFrame:
    """Per external table: matched steps, how many scanned rows they filtered, and their spill. Expects step_outputs with ext_id."""
    per = found.where(F.col("ext_id").isNotNull()).groupBy("ext_id").agg(F.count("output_rows").alias("output_metric_match_count"), F.sum(F.when(F.col("output_rows").isNotNull(), zero("returned_rows"))).alias("_in"), F.sum("output_rows").alias("_out"), F.sum(zero("spill_blocks")).alias("external_spill_blocks"))
    return per.withColumn("row_filter_efficiency_pct", F.when(F.col("_in") > 0, F.greatest(F.lit(0.0), 100.0 * (F.col("_in") - F.col("_out")) / F.col("_in")))).drop("_in", "_out")


def star(catalog: DataFrame, rolled: DataFrame, columns: DataFrame, outputs: DataFrame, errors: DataFrame) -> DataFrame:
    """The catalogue with its columns, activity, step outputs and errors; tables without any of them stay. All but the catalogue have one row for each table."""
    out = external_tables(catalog, rolled)
    for part, key in ((columns, "external_table_key"), (outputs, "ext_id"), (errors, "ext_id")):
        out = out.join(part, key, "left")
    return out


def scanned_most(tables: DataFrame) -> DataFrame:
    """External tables that scanned anything, most first."""
    return tables.where(zero("scan_gb") > 0).orderBy(F.desc("scan_gb"), "ext_id")


def unpartitioned(tables: DataFrame) -> DataFrame:
    """External tables in use that have no partition key, most scanned first."""
    return tables.where((zero("query_count") > 0) & (zero("partition_keys") <= 0)).orderBy(F.desc(zero("scan_gb")), "ext_id")


def from_activity(segments: DataFrame) -> DataFrame:
    """A catalogue made of the names that activity mentions, where none was captured."""
    parts = F.split(F.lower("table_name"), r"\.")
    named = segments.where(F.coalesce("table_name", F.lit("")) != "")
    return named.select(F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise("").alias("schema_name"), F.element_at(parts, -1).alias("table_name")).distinct()


def hourly_rollup(segments: DataFrame, hour: Column) -> DataFrame:
    """Hourly slices, then their sums: averages are weighted by their counts; queries that run through several hours
    count once per hour (a named approximation of the source's rollup) beside the exact distinct count."""
    slices = segments.withColumn("hour", hour).groupBy("file_root", "hour").agg(F.size(F.collect_set("query_id")).cast("long").alias("queries"), F.count("*").alias("n"), F.avg("duration").alias("avg_duration"), F.sum("returned_rows").alias("rows"), F.min("s3list_time").alias("low"), F.max("s3list_time").alias("high"))
    return slices.groupBy("file_root").agg(F.sum("queries").alias("query_slices"), F.sum("n").alias("segments"), (F.sum(F.col("avg_duration") * F.col("n")) / F.sum("n")).alias("avg_duration"), F.sum("rows").alias("returned_rows"), F.min("low").alias("least_list_ms"), F.max("high").alias("most_list_ms"))


def column_tiles(columns: DataFrame, preview: int = 12) -> DataFrame:
    """Columns of external tables as one row per table: ordered names, partition keys, nullable count, types, preview."""
    ordered = F.array_sort(F.collect_list(F.struct("column_number", "column_name")))
    keys = F.array_sort(F.collect_list(F.when(F.col("partition_key_ordinal") > 0, F.struct("partition_key_ordinal", "column_name"))))
    out = columns.groupBy("external_table_key").agg(F.count("*").alias("column_count"), ordered.alias("o"), keys.alias("k"), F.count(F.when(F.col("is_nullable"), 1)).alias("nullable_count"), F.array_sort(F.collect_set("data_type")).alias("t"))
    names = F.transform("o", lambda x: x["column_name"])
    return out.select("external_table_key", "column_count", "nullable_count", F.array_join(names, ",").alias("columns"), F.array_join(F.transform("k", lambda x: x["column_name"]), ",").alias("partition_keys"), F.array_join("t", ",").alias("data_types"), F.array_join(F.slice(names, 1, preview), ",").alias("preview"))


def severity(tables: DataFrame, mode: str) -> DataFrame:
    """A severity from 0 to 3 by one of several readings."""
    levels = {"partition": ("partition_pruning_pct", (90, 50, 10), True), "warnings": ("warning_count", (0, 5, 50), False), "scan": ("scan_gb", (1, 100, 1000), False), "runtime": ("external_duration_s", (60, 600, 3600), False), "files": ("scanned_files", (100, 10_000, 100_000), False)}
    name, (a, b, c), low = levels[mode]
    v = zero(name)
    bad = (lambda t: v < t) if low else (lambda t: v > t)
    return tables.withColumn("severity", F.when(bad(c), 3).when(bad(b), 2).when(bad(a), 1).otherwise(0).cast("long"))


def errors_matched(errors: DataFrame, catalog: DataFrame) -> DataFrame:
    """Errors per external table by the longest location prefix."""
    keys = catalog.select("ext_id", F.regexp_replace("location", "/+$", "").alias("key"))
    e = errors.select("error_id", "error_code", F.posexplode(prefixes(F.col("file_location"))).alias("rank", "key"))
    best = W.partitionBy("error_id").orderBy("rank", "ext_id")
    hit = e.join(keys, "key").withColumn("n", F.row_number().over(best)).where("n = 1")
    return hit.groupBy("ext_id").agg(F.count("*").alias("error_count"), F.size(F.collect_set("error_code")).cast("long").alias("error_codes"))
