"""Capture: filters over live telemetry, incremental marks, external readers, file and paste imports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import glob_like
from .pastes import STEP_ALIASES, STEP_COLUMNS, TABLE_ALIASES, TABLE_COLUMNS, imported, pasted, pasted_steps, pasted_tables, typed  # noqa: F401

FETCH = 25_000


# Readers ---------------------------------------------------------------------------------------
def jdbc(spark: SparkSession, url: str, query: str, driver: str | None = None, timeout_s: int = 0, init: str | None = None, partition: tuple[str, int, int, int] | None = None, **properties: str) -> DataFrame:
    """A query of another database; `partition` (column, low, high, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", FETCH).options(**properties)
    if driver:
        reader = reader.option("driver", driver)
    if timeout_s:
        reader = reader.option("queryTimeout", timeout_s)
    if init:
        reader = reader.option("sessionInitStatement", init)
    if partition:
        column, low, high, parts = partition
        return reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()
    return reader.option("query", query).load()


def columns_of(source: DataFrame) -> list[str]:
    """Columns without reading a row."""
    return source.limit(0).columns


def missing_columns(source: DataFrame, needed: list[str]) -> list[str]:
    have = {c.lower() for c in columns_of(source)}
    return [c for c in needed if c.lower() not in have]


def retargeted(name: str, mirror: str | None) -> str:
    """A catalogue relation's name in a mirror schema, where there is one."""
    return f"{mirror}.{name.split('.')[-1]}" if mirror else name


# Filters ---------------------------------------------------------------------------------------
def root_floor(basis: str, least_s: float) -> Column:
    return F.coalesce(F.col(basis), F.lit(0)) / 1e6 >= least_s


def root_window(start: str, hours: float, now: Column | None = None) -> Column:
    return F.col(start) >= (now if now is not None else F.current_timestamp().cast("timestamp_ntz")) - F.expr(f"make_dt_interval(0, 0, {int(hours * 60)}, 0)")


def roots(history: DataFrame, least_s: float = 30.0, basis: str = "execution_time", hours: float | None = None, now: Column | None = None) -> DataFrame:
    kept = history.where(root_floor(basis, least_s))
    return kept.where(root_window("start_time", hours, now)) if hours else kept


def high_water(*histories: DataFrame) -> DataFrame:
    """One row: the latest (start_time, query_id) over all histories, nulls last."""
    both = None
    for h in histories:
        part = h.select("start_time", "query_id")
        both = part if both is None else both.unionByName(part)
    return both.orderBy(F.desc_nulls_last("start_time"), F.desc("query_id")).limit(1)


def newer(history: DataFrame, time: Column, query_id: Column) -> DataFrame:
    """Rows past a high-water mark; rows without a time go by id."""
    t = F.col("start_time")
    return history.where((t > time) | ((t == time) & (F.col("query_id") > query_id)) | (t.isNull() & (F.col("query_id") > query_id)))


def of_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of the target queries."""
    return rows.join(targets.select("query_id").distinct(), "query_id", "left_semi")


def external_scope(schemas: list[str], patterns: list[str], schema: str = "schema_name", table: str = "table_name") -> Column:
    """Schemas by name, tables by glob; an empty list lets all pass."""
    out = F.lit(True)
    if schemas:
        out = out & F.lower(F.trim(F.col(schema))).isin([s.lower() for s in schemas])
    if patterns:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | glob_like(table, p)
        out = out & hit
    return out


def in_scope(rows: DataFrame, snapshot: str | None = None, namespaces: list[str] | None = None) -> DataFrame:
    """One snapshot and some namespaces; both are partition columns of the stored tables."""
    if snapshot is not None:
        rows = rows.where(F.col("snapshot_id") == snapshot)
    return rows.where(F.col("namespace_id").isin(namespaces)) if namespaces else rows


def above_floors(rows: DataFrame, floors: dict[str, float], value: str = "elapsed_s") -> DataFrame:
    """Rows at or above their namespace's floor; an unknown namespace has floor 0."""
    if not floors:
        return rows
    table = F.create_map(*[F.lit(x) for kv in floors.items() for x in kv])
    return rows.where(F.coalesce(F.col(value), F.lit(0.0)) >= F.coalesce(F.try_element_at(table, F.col("namespace_id")), F.lit(0.0)))


def best_snapshot(rows: DataFrame, wanted: str | None = None) -> str | None:
    """The wanted snapshot if it has rows, else the one with most rows."""
    if wanted is not None and not rows.where(F.col("snapshot_id") == wanted).isEmpty():
        return wanted
    top = rows.groupBy("snapshot_id").count().orderBy(F.desc("count"), F.desc("snapshot_id")).limit(1).collect()
    return top[0]["snapshot_id"] if top else None


# Definitions and made-up data -------------------------------------------------------------------
def definitions(rows: DataFrame, prefix: str = "definition_part_") -> DataFrame:
    """Definition parts in order as one source text, trimmed at the end."""
    parts = sorted(c for c in rows.columns if c.startswith(prefix))
    text = F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in parts])
    return rows.withColumn("source_definition", F.rtrim(text)).drop(*parts)


def snapshot(spark: SparkSession, queries: int = 420, tables: int = 360, seed: int = 20260624) -> dict[str, DataFrame]:
    """A made-up snapshot from a seed: `queries` runs of patterns of six, and `tables` tables."""
    r = lambda c, salt, n: F.pmod(F.xxhash64(F.col(c), F.lit(seed + salt)), F.lit(n))
    q = spark.range(queries).withColumn("pattern", F.expr("id div 6"))
    history = q.select(F.col("id").alias("query_id"), r("pattern", 1, 40).alias("user_id"), F.concat(F.lit("db"), r("pattern", 2, 3).cast("string")).alias("database_name"), F.element_at(F.array(F.lit("SELECT"), F.lit("INSERT"), F.lit("UNLOAD"), F.lit("CALL")), (r("pattern", 3, 4) + 1).cast("int")).alias("query_type"), F.lit("success").alias("status"), ((r("id", 4, 3600) + 1) * 1_000_000).alias("elapsed_time"), F.concat(F.lit("select c"), r("pattern", 5, 9).cast("string"), F.lit(" from s.t"), r("pattern", 6, tables).cast("string"), F.lit(" where d = "), F.col("id").cast("string")).alias("sql_text"))
    catalog = spark.range(tables).select(F.col("id").alias("table_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("table"), F.lit("s").alias("schema"), F.element_at(F.array(F.lit("EVEN"), F.lit("ALL"), F.lit("KEY(id)"), F.lit("AUTO(EVEN)")), (r("id", 7, 4) + 1).cast("int")).alias("diststyle"), r("id", 8, 50_000).alias("size"), r("id", 9, 100).alias("unsorted"), r("id", 10, 60).alias("stats_off"), r("id", 11, 8).alias("skew_rows"))
    return {"history": history, "tables": catalog}


def collected(tasks: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """Frames of the tasks that succeed, and (name, error) of those that fail: one failure does not stop a load."""
    done, failed = {}, []
    for name, task in tasks.items():
        try:
            done[name] = task()
        except Exception as e:  # reported to the caller, who decides on promotion
            failed.append((name, f"{type(e).__name__}: {e}"))
    return done, failed
