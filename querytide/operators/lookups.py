"""Lookups, memberships, scored matches and the filters of the interactive views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import shapes
from ..functions.exprs import missing_key, split_names, zero
from .triage import suffixes


def hydrated(groups: DataFrame, queries: DataFrame, columns: list[str]) -> DataFrame:
    """Group members with fresh query columns where they have any, keyed by namespace and query."""
    fresh = queries.select(F.col("namespace_id").alias("_ns"), F.col("query_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = groups.join(fresh, groups["namespace_id"].eqNullSafe(fresh["_ns"]) & (groups["query_id"] == fresh["_id"]), "left").drop("_ns", "_id")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def first_wins(catalog: DataFrame, order: str) -> DataFrame:
    """suffix -> table_id; of several tables with a suffix the first in `order`."""
    index = catalog.select("table_id", F.col(order).alias("o"), F.explode(suffixes(F.col("table_key"))).alias("suffix"))
    return index.groupBy("suffix").agg(F.min_by("table_id", F.struct("o", "table_id")).alias("table_id"))


def table_sets(groups: DataFrame, external: DataFrame, views: DataFrame) -> DataFrame:
    """Whether a group's tables are all local, all external or mixed, and whether it reads views.

    external, views: one column `name` (lower case)."""
    named = groups.select("repeat_group_id", F.explode_outer(F.transform(split_names("sql_tables"), lambda x: F.lower(x))).alias("name"))
    e, v = external.select("name").distinct().withColumn("_e", F.lit(1)), views.select("name").distinct().withColumn("_v", F.lit(1))
    per = named.join(e, "name", "left").join(v, "name", "left").groupBy("repeat_group_id").agg(F.count("name").alias("n"), F.count("_e").alias("external_tables"), F.count("_v").alias("views"))
    kind = F.when(F.col("n") == 0, "none").when(F.col("external_tables") == 0, "local").when(F.col("external_tables") == F.col("n"), "external").otherwise("mixed")
    return per.select("repeat_group_id", kind.alias("table_set"), (F.col("views") > 0).alias("uses_views"), "external_tables")


def external_views(views: DataFrame, external: DataFrame) -> DataFrame:
    """Views whose text names an external table, by any suffix of two parts or more (or a bare name that one table has).

    Names keep their numeric suffixes here: a stem would be no table's name."""
    keys = external.select(F.col("external_table_key").alias("key"), F.explode(suffixes(F.col("external_table_key"))).alias("suffix"))
    sure = keys.groupBy("suffix").agg(F.min("key").alias("key"), F.size(F.collect_set("key")).alias("n")).where((F.col("n") == 1) | F.col("suffix").contains("."))
    said = views.select("view_key", F.explode(shapes.tables(shapes.regex_shape("source_definition", run_suffix=False))).alias("suffix"))
    return said.join(sure, "suffix").groupBy("view_key").agg(F.array_sort(F.collect_set("key")).alias("external_tables"))


def plan_matches(joins: DataFrame, explain: DataFrame, steps: DataFrame) -> DataFrame:
    """For each join of a statement the plan node that fits best, with its measured rows and spill.

    joins: query_id, join_no, left_column, right_column, target. Scored by the names that stand in the node's text, more
    for a condition and for a join node; both sides meet per query, so a pair is one query's join and node."""
    text = F.lower(F.concat_ws(" ", "plan_node", "plan_info"))
    e = explain.select("query_id", "plan_node_id", text.alias("node"))
    has = lambda c: F.when((F.col(c) != "") & F.col("node").contains(F.lower(c)), 1).otherwise(0)
    score = has("target") * 3 + has("left_column") * 2 + has("right_column") * 2 + F.when(F.col("node").contains("cond:"), 1).otherwise(0) + F.when(F.col("node").rlike("hash join|merge join|nested loop"), 2).otherwise(0)
    best = joins.join(e, "query_id").groupBy("query_id", "join_no").agg(F.max_by("plan_node_id", F.struct(score.alias("s"), (-F.col("plan_node_id")).alias("p"))).alias("plan_node_id"), F.max(score).alias("score")).where("score >= 2")
    d = steps.groupBy("query_id", "plan_node_id").agg(F.sum("output_rows").alias("output_rows"), F.sum(zero("spill_local") + zero("spill_remote")).alias("spill_blocks"))
    return best.join(d, ["query_id", "plan_node_id"], "left")


def recipients(rows: DataFrame, roster: DataFrame, user: str = "user_name") -> DataFrame:
    """Rows with the roster's email of their user."""
    r = roster.select(F.lower(F.trim("account")).alias("_a"), "email").dropDuplicates(["_a"])
    return rows.join(r, F.lower(F.trim(user)) == F.col("_a"), "left").drop("_a")


def execution_evidence(steps: DataFrame) -> DataFrame:
    """Per table: scans, rows, skew, spill and the share of its query's time."""
    total = F.sum("duration").over(W.partitionBy("query_id"))
    s = steps.withColumn("share", F.when(total > 0, F.col("duration") / total))
    return s.where(F.col("table_id").isNotNull()).groupBy("table_id").agg(F.count("*").alias("scans"), F.sum("input_rows").alias("input_rows"), F.max("data_skewness").alias("max_skew"), F.sum(zero("spill_local") + zero("spill_remote")).alias("spill_blocks"), F.max("share").alias("max_share"))


def parent_rows(members: DataFrame, group: str, numbers: list[str]) -> DataFrame:
    """One parent row per group: means of the numbers, the worst member's id."""
    worst = F.max_by("query_id", F.struct(zero("elapsed_s").alias("e"), (-F.col("query_id")).alias("q"))).alias("query_id")
    return members.groupBy(group).agg(worst, F.count("*").alias("runs"), *[F.avg(c).alias(c) for c in numbers])


def filtered_tables(tables: DataFrame, database: str | None = None, schema: str | None = None, least_mb: float = 0, least_rows: float = 0, problems_only: bool = False) -> DataFrame:
    """The heat map's rows, largest first."""
    out = tables.where((zero("size_mb") >= least_mb) & (zero("tbl_rows") >= least_rows))
    for c, v in (("source_db", database), ("schema_name", schema)):
        if v:
            out = out.where(F.lower(c) == v.lower())
    if problems_only:
        out = out.where(missing_key("sortkey1") | (zero("unsorted_pct") >= 20) | (zero("stats_off") >= 10) | (zero("skew_rows") >= 4))
    return out.orderBy(F.desc("size_mb"), F.desc("tbl_rows"), "table_id")


def searched(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows that hold a text, as it stands, in one of the columns."""
    both = F.lower(F.concat_ws(" ", *columns))
    return rows.where(both.contains(text.strip().lower())) if text.strip() else rows


def focused(assessed: DataFrame, code: str | None = None, least: int = 0) -> DataFrame:
    """The optimisation queue: tables with an issue code and a score, worst first."""
    out = assessed.where(F.col("score") >= least)
    if code:
        out = out.where(F.exists("issues", lambda i: i["code"] == code))
    return out.orderBy(F.desc("score"), "ext_id")


def group_ids(members: DataFrame) -> DataFrame:
    """All ids of each group, once, in order."""
    return members.groupBy("constraint_key").agg(F.array_sort(F.collect_set("query_id")).alias("query_ids"))


def group_users(members: DataFrame) -> DataFrame:
    """Users of each group by how often they ran it."""
    return members.groupBy("constraint_key", "user_name").agg(F.count("*").alias("runs"))


def most_common(rows: DataFrame, group: str, value: Column, order: str, k: int = 3) -> DataFrame:
    """The k most frequent values per group; of equally frequent ones the first seen."""
    counted = rows.select(group, value.alias("value"), F.col(order).alias("o")).groupBy(group, "value").agg(F.count("*").alias("n"), F.min("o").alias("first_seen"))
    best = W.partitionBy(group).orderBy(F.desc("n"), "first_seen", "value")
    return counted.withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= k)


def filtered_external(tables: DataFrame, schema: str | None = None, least_gb: float = 0, least_queries: int = 0, problems_only: bool = False) -> DataFrame:
    """The external heat map's rows, most scanned first; problems are tables without partition keys, with poor pruning or with warnings."""
    out = tables.where((zero("scan_gb") >= least_gb) & (zero("query_count") >= least_queries))
    if schema:
        out = out.where(F.lower("schema_name") == schema.lower())
    if problems_only:
        out = out.where((zero("partition_keys") <= 0) | (zero("partition_pruning_pct") < 50) | (zero("warning_count") > 0))
    return out.orderBy(F.desc(zero("scan_gb")), "ext_id")


def catalog_closure(names: list[str], catalog: DataFrame, views: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables and views that some names reach, through view bodies, until nothing new comes.

    catalog: table_key; views: view_key, source_definition. Returns (tables, views) of the closure."""
    spark = catalog.sparkSession
    wanted = spark.createDataFrame([(n.lower(),) for n in names], "name string")
    index = views.select("view_key", "source_definition", F.explode(suffixes(F.col("view_key"))).alias("name"))
    seen, frontier = wanted, wanted
    keep = (lambda df: df.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda df: df)  # cuts the lineage of long chains
    while True:
        bodies = index.join(frontier, "name", "left_semi").select(F.explode(shapes.tables(shapes.regex_shape("source_definition", run_suffix=False))).alias("name")).distinct()
        frontier = keep(bodies.join(seen, "name", "left_anti"))
        if frontier.isEmpty():
            break
        seen = keep(seen.unionByName(frontier))
    t = catalog.withColumn("name", F.explode(suffixes(F.col("table_key")))).join(seen, "name", "left_semi").drop("name").dropDuplicates(["table_key"])
    return t, index.join(seen, "name", "left_semi").select("view_key").distinct()


def cache_first(names: DataFrame, cache: DataFrame, live: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(found rows, rows to add to the cache): live rows only for the names that the cache lacks."""
    hit = cache.join(names, key, "left_semi")
    fresh = live.join(names.join(cache.select(key), key, "left_anti"), key, "left_semi")
    return hit.unionByName(fresh), fresh


def qualified_reviews(slow: DataFrame, references: DataFrame, review: DataFrame) -> DataFrame:
    """Each query's tables with their attention, best match first."""
    return references.join(review.select("table_id", "table_attention_score"), "table_id").join(slow.select("query_id", "risk_score"), "query_id").orderBy(F.desc("risk_score"), F.desc("table_attention_score"), "query_id", "table_id")
