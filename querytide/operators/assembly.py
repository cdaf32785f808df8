"""External-table facts assembled from frames that were captured one by one, any of which may be missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import zero

# The columns and types of each staged frame.
STAGES: dict[str, str] = {
    "svv_external_tables": "redshift_database_name string, schemaname string, tablename string, tabletype string, location string, input_format string, output_format string, serialization_lib string, serde_parameters string, compressed bigint, parameters string",
    "external_column_stats": "external_table_key string, columnname string, part_key bigint",
    "sys_query_history": "query_id bigint, database_name string",
    "sys_external_query_detail": "user_id bigint, query_id bigint, transaction_id bigint, child_query_sequence bigint, segment_id bigint, source_type string, start_time timestamp, end_time timestamp, duration bigint, total_partitions bigint, qualified_partitions bigint, scanned_files bigint, returned_rows bigint, returned_bytes bigint, file_format string, file_location string, external_query_text string, warning_message string, table_name string, is_recursive string, is_nested string, s3list_time bigint, get_partition_time bigint",
    "sys_query_detail": "query_id bigint, segment_id bigint, table_name string, output_bytes bigint, output_rows bigint, data_skewness bigint, time_skewness bigint, spilled_block_local_disk bigint, spilled_block_remote_disk bigint, step_id bigint, step_name string, source string",
    "sys_external_query_error": "query_id bigint, file_location string, rowid string, column_name string, trigger string, action string, error_code bigint",
}
# Words that tell a warning's category, and an error's; the first that fits counts.
WARNING_WORDS = {
    "security": ("permission", "access denied", "authoriz", "credential"),
    "partition": ("partition",),
    "schema_format": ("schema", "column", "type", "serde", "format"),
    "file_location": ("file", "s3", "location", "path"),
    "connectivity": ("timeout", "network", "retry"),
}
ERROR_WORDS = {"truncation": ("truncat",), "overflow": ("overflow",), "invalid_data": ("invalid",), "null_handling": ("null",)}
EXTERNAL_SOURCES = ("s3", "external", "spectrum")
TRUE_WORDS = ("t", "true", "y", "yes", "1")
GIB = float(1 << 30)


def staged(spark: SparkSession, stages: dict[str, DataFrame | None], name: str) -> DataFrame:
    """A stage by its contract: names meet without case and outer blanks, values that do not fit a type and missing columns are null, and a missing stage has no rows."""
    contract = [x.rsplit(" ", 1) for x in STAGES[name].split(", ")]
    df = stages.get(name)
    if df is None:
        return spark.createDataFrame([], STAGES[name])
    have = {c.strip().lower(): c for c in reversed(df.columns)}
    return df.select(*[(F.col(f"`{have[c]}`").try_cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in contract])


def _low(c: str | Column) -> Column:
    return F.lower(F.trim(c))


def category(text: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """The first category one of whose words the text holds, 'other' without one, null for blank texts."""
    out = F.when(F.coalesce(F.trim(text), F.lit("")) != "", F.lit("other"))
    for name, found in reversed(words.items()):
        out = F.when(text.rlike("(?i)" + "|".join(found)), F.lit(name)).otherwise(out)
    return out


def catalogue(tables: DataFrame) -> DataFrame:
    kept = tables.where(_low(F.coalesce("tabletype", F.lit("TABLE"))).isin("table", ""))
    db, schema, name = (F.trim(c) for c in ("redshift_database_name", "schemaname", "tablename"))
    return kept.select(
        F.lower(F.concat(db, F.lit("."), schema, F.lit("."), name)).alias("external_table_key"), db.alias("redshift_database_name"), schema.alias("schema_name"), name.alias("table_name"), F.trim("location").alias("s3_location"),
        F.coalesce("tabletype", F.lit("TABLE")).alias("table_type"), "input_format", "output_format", "serialization_lib", "serde_parameters", "compressed", F.col("parameters").alias("table_parameters"),
    )


def column_facts(columns: DataFrame) -> DataFrame:
    """(external_table_key, column_count, partition_key_count, partition_key_columns): keys in their order, equal orders by name."""
    part = F.col("part_key") > 0
    keys = F.array_sort(F.collect_list(F.when(part & (F.trim("columnname") != ""), F.struct("part_key", "columnname"))))
    out = columns.groupBy("external_table_key").agg(F.count("*").alias("column_count"), F.count(F.when(part, 1)).alias("partition_key_count"), keys.alias("k"))
    return out.withColumn("partition_key_columns", F.array_join(F.transform("k", lambda x: x["columnname"]), ", ")).drop("k")


def by_location(places: DataFrame, catalog: DataFrame) -> DataFrame:
    """(db, place, external_table_key): for each database with such a one, its catalogue's longest location that a place begins with.

    Only distinct places (column place) are asked for, so the rows that they come from need not meet their queries' databases first.
    The lengths that occur among locations are few (a path's length bounds them), so a place is cut to each of them and meets the catalogue by equality, not by a comparison with every entry."""
    places = places.select("place").where("place <> ''").distinct()
    kept = catalog.where("s3_location <> ''").select(F.lower("redshift_database_name").alias("db"), F.lower("s3_location").alias("start"), "external_table_key")
    lengths = kept.agg(F.sort_array(F.collect_set(F.length("start")), asc=False).alias("lengths"))
    cut = places.withColumn("size", F.explode(lengths.scalar())).where(F.col("size") <= F.length("place")).withColumn("start", F.left("place", F.col("size")))
    return cut.join(kept, "start").groupBy("db", "place").agg(F.min_by("external_table_key", F.struct(-F.col("size"), "external_table_key")).alias("external_table_key"))


_SEGMENT = ["query_id", "child_query_sequence", "segment_id", "name", "place"]
#: Rows of the catalogue's names, or locations, that may be broadcast; beyond, they are joined.
MOST_BROADCAST = 100_000


def _few(rows: DataFrame) -> bool:
    return rows.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def segments(details: DataFrame, history: DataFrame) -> DataFrame:
    """Object-store segments with their query's own database, each once; partitioned by query_id, as `with_outputs` needs them."""
    asked, place = history.select("query_id", _low("database_name").alias("db")), F.coalesce(_low("file_location"), F.lit(""))
    seg = details.where(_low("source_type") == "s3").join(asked, "query_id").withColumn("name", F.coalesce(_low("table_name"), F.lit(""))).withColumn("place", place)
    one = W.partitionBy(*_SEGMENT).orderBy("start_time", "end_time", "duration", "returned_rows", "returned_bytes")
    return seg.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n", "table_name", "file_location")


def mapped(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Segments with their catalogue entry in the query's own database: full name, then schema and table, then table, then longest location.

    Up to MOST_BROADCAST names and locations are broadcast, so the segments, the widest rows here, stay where their queries are: what no
    name finds is cut to each length of a location, and the longest cut that meets one counts. Beyond, segments are shuffled to them."""
    db, size = F.lower("redshift_database_name").alias("db"), F.length(F.coalesce("s3_location", F.lit("")))
    forms = F.array(*[F.struct(F.lit(k).alias("tier"), x.alias("name")) for k, x in enumerate((F.col("external_table_key"), F.lower(F.concat("schema_name", F.lit("."), "table_name")), F.lower("table_name")))])
    names = catalog.select(db, "external_table_key", size.alias("size"), F.explode(forms).alias("f")).select("db", "external_table_key", "size", "f.*")
    best = names.groupBy("db", "name").agg(F.min_by("external_table_key", F.struct("tier", -F.col("size"), "external_table_key")).alias("by_name"))
    named = found.join(F.broadcast(best) if _few(best) else best, ["db", "name"], "left")
    starts = catalog.where("s3_location <> ''").groupBy(db, F.lower("s3_location").alias("start")).agg(F.min("external_table_key").alias("by_place"))
    if _few(starts):
        lengths = starts.agg(F.collect_set(F.length("start")).alias("lengths")).scalar()
        cut = named.withColumn("_lengths", lengths).withColumn("_size", F.explode_outer(F.when(F.col("by_name").isNull(), F.filter("_lengths", lambda n: n <= F.length("place"))))).withColumn("start", F.left("place", F.col("_size")))
        met = cut.join(F.broadcast(starts), ["db", "start"], "left").where("by_name is not null or by_place is not null")
        placed = met.withColumn("_n", F.row_number().over(W.partitionBy(*_SEGMENT).orderBy(F.desc("_size")))).where("_n = 1").drop("_n", "_lengths", "_size", "start")
    else:
        placed = named.join(by_location(found.select("place"), catalog).withColumnRenamed("external_table_key", "by_place"), ["db", "place"], "left")
    return placed.withColumn("external_table_key", F.coalesce("by_name", "by_place")).where("external_table_key is not null").drop("by_name", "by_place")


def with_outputs(segments: DataFrame, steps: DataFrame) -> DataFrame:
    """Segments with what the scans of their query and segment put out: the step of the same name, else one whose name ends the other after a dot, first by name.

    Scans are shuffled once, by query, and so meet the segments where these are: the join's key is the query alone, and the segment is
    compared by a condition that is no key."""
    scans = steps.where((F.col("step_id") >= 0) & (_low("step_name") == "scan") & _low("source").isin(*EXTERNAL_SOURCES)).repartition("query_id")
    out = scans.groupBy(F.col("query_id").alias("_q"), F.col("segment_id").alias("_s"), _low("table_name").alias("_t")).agg(
        F.sum("output_bytes").alias("output_bytes"), F.sum("output_rows").alias("output_rows"), F.max("data_skewness").alias("data_skewness"), F.max("time_skewness").alias("time_skewness"),
        F.sum(F.col("spilled_block_local_disk") + F.col("spilled_block_remote_disk")).alias("spill_blocks"),
    )
    a, b = F.col("name"), F.col("_t")
    fits = (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))
    joined = segments.join(out, (F.col("query_id") == F.col("_q")) & F.col("segment_id").between(F.col("_s"), F.col("_s")) & fits, "left")
    first = W.partitionBy(*_SEGMENT).orderBy(F.when(a == b, 0).otherwise(1), "_t")
    return joined.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_q", "_s", "_t")


def activity(found: DataFrame) -> DataFrame:
    warning = category(F.col("warning_message"), WARNING_WORDS)
    n = lambda condition: F.sum(F.when(condition, 1).otherwise(0))
    total, kept = F.col("total_partitions"), F.col("qualified_partitions")
    sums = {"gross_scan_bytes": "returned_bytes", "gross_output_bytes": "output_bytes", "gross_scan_rows": "returned_rows", "gross_output_rows": "output_rows", "total_partitions_considered": "total_partitions", "qualified_partitions_scanned": "qualified_partitions", "scanned_files": "scanned_files", "external_duration_us": "duration", "s3list_time_ms": "s3list_time", "get_partition_time_total_raw": "get_partition_time", "external_spill_blocks": "spill_blocks"}
    means = {"avg_files_per_segment": "scanned_files", "avg_external_duration_us": "duration", "avg_s3list_time_ms": "s3list_time", "avg_get_partition_time_raw": "get_partition_time"}
    most = {"max_files_per_segment": "scanned_files", "max_external_duration_us": "duration", "max_s3list_time_ms": "s3list_time", "max_get_partition_time_raw": "get_partition_time", "max_data_skewness": "data_skewness", "max_time_skewness": "time_skewness", "observed_file_format": "file_format", "observation_end_time": "end_time"}
    marked = found.withColumn("_warning", warning)
    return marked.groupBy("external_table_key").agg(
        F.min("start_time").alias("observation_start_time"), F.countDistinct("query_id").alias("query_count"), F.count("*").alias("external_segment_count"), F.countDistinct("user_id").alias("user_count"),
        *[F.sum(c).alias(k) for k, c in sums.items()], *[F.avg(c).alias(k) for k, c in means.items()], *[F.max(c).alias(k) for k, c in most.items()],
        F.count("output_bytes").alias("output_metric_match_count"), n(total > kept).alias("pruning_event_count"), n((total > 0) & (total == kept)).alias("no_pruning_event_count"),
        n(_low("is_recursive").isin(*TRUE_WORDS)).alias("recursive_scan_count"), n(_low("is_nested").isin(*TRUE_WORDS)).alias("nested_scan_count"),
        F.count("_warning").alias("warning_event_count"), *[n(F.col("_warning") == k).alias(f"{k}_warning_count") for k in (*WARNING_WORDS, "other")], F.max(F.when(F.col("_warning").isNotNull(), F.col("warning_message"))).alias("warning_example"),
    )


def errors(rows: DataFrame, history: DataFrame, catalog: DataFrame) -> DataFrame:
    """Errors per external table by category; a row counts once for query, file, row, column and code."""
    once = ["query_id", "file_location", "rowid", "column_name", "error_code"]
    words = F.concat_ws(" ", "action", "trigger")
    kind = F.coalesce(category(words, ERROR_WORDS), F.lit("other"))
    e = rows.withColumn("_kind", kind).repartition("query_id").groupBy(*once).agg(F.min("_kind").alias("_kind"))
    e = e.join(history.select("query_id", _low("database_name").alias("db")), "query_id").withColumn("place", _low("file_location"))
    found = e.join(by_location(rows.select(_low("file_location").alias("place")), catalog), ["db", "place"])
    n = lambda k: F.sum(F.when(F.col("_kind") == k, 1).otherwise(0)).alias(f"{k}_error_count")
    return found.groupBy("external_table_key").agg(F.count("*").alias("sampled_error_count"), F.countDistinct("query_id").alias("queries_with_sampled_errors"), *[n(k) for k in (*ERROR_WORDS, "other")], F.countDistinct("error_code").alias("distinct_error_code_count"), F.countDistinct("column_name").alias("affected_column_count"))


#: Counts and sums that are 0, not null, for a table without activity or errors.
_ZERO = ["column_count", "partition_key_count", "query_count", "external_segment_count", "user_count", "gross_scan_bytes", "gross_scan_rows", "output_metric_match_count", "total_partitions_considered", "qualified_partitions_scanned", "pruning_event_count", "no_pruning_event_count", "scanned_files", "s3list_time_ms", "recursive_scan_count", "nested_scan_count", "warning_event_count", "external_spill_blocks", "sampled_error_count", "queries_with_sampled_errors", "distinct_error_code_count", "affected_column_count", *(f"{k}_warning_count" for k in (*WARNING_WORDS, "other")), *(f"{k}_error_count" for k in (*ERROR_WORDS, "other"))]


def assembled(spark: SparkSession, stages: dict[str, DataFrame | None]) -> DataFrame:
    """One row per external table from the staged frames (see STAGES). A missing stage leaves its facts null or 0.

    Everything meets by equality: segments and steps by query, names and locations by database and key."""
    get = lambda name: staged(spark, stages, name)
    catalog, history = catalogue(get("svv_external_tables")), get("sys_query_history")
    acts = activity(mapped(with_outputs(segments(get("sys_external_query_detail"), history), get("sys_query_detail")), catalog))
    out = catalog
    for part in (column_facts(get("external_column_stats")), acts, errors(get("sys_external_query_error"), history, catalog)):
        out = out.join(part, "external_table_key", "left")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b).cast("double"))
    kept = lambda c: 100.0 * (1.0 - F.least(F.col(c), F.lit(1.0)))
    filtered = F.col("row_filter_efficiency_pct")
    out = out.withColumns({"output_to_scan_byte_ratio": ratio("gross_output_bytes", "gross_scan_bytes"), "output_to_scan_row_ratio": ratio("gross_output_rows", "gross_scan_rows"), "partition_pruning_pct": F.when(F.col("total_partitions_considered") > 0, 100.0 * (1.0 - F.col("qualified_partitions_scanned") / F.col("total_partitions_considered").cast("double")))})
    out = out.withColumns({"byte_reduction_pct_estimate": kept("output_to_scan_byte_ratio"), "row_filter_efficiency_pct": kept("output_to_scan_row_ratio"), **{c: zero(c) for c in _ZERO}, "partition_key_columns": F.coalesce("partition_key_columns", F.lit("")), "catalog_partition_count": F.lit(0).cast("bigint"), "get_partition_time_unit": F.lit("AWS_NOT_DOCUMENTED")})
    out = out.withColumns({"gross_scan_gb": F.col("gross_scan_bytes") / GIB, "gross_output_gb": F.col("gross_output_bytes") / GIB, "external_duration_s": zero("external_duration_us") / 1e6, "avg_external_duration_s": F.col("avg_external_duration_us") / 1e6, "max_external_duration_s": F.col("max_external_duration_us") / 1e6})
    band = F.when(F.col("query_count") == 0, "NO_ACTIVITY").when(F.col("gross_output_rows").isNull(), "OUTPUT_UNAVAILABLE").when(filtered >= 90, "HIGHLY_SELECTIVE").when(filtered >= 50, "SELECTIVE").when(filtered >= 10, "LIGHT_FILTERING").otherwise("LOW_FILTERING")
    return out.withColumn("filtering_assessment", band).drop("external_duration_us", "avg_external_duration_us", "max_external_duration_us")
