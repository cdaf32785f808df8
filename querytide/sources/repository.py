"""A kept catalogue: built once, read by name, filled from the live catalogue where it lacks a table."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Store

#: Names of one predicate, and names that may travel in predicates; more are joined.
BATCH, MOST_NAMES = 500, 50_000
KEY = ["database_name", "schema_name", "table_name"]


def plain(c: str | Column) -> Column:
    """A name as the catalogue keeps it: lower case, no quotes, no outer blanks."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), '"', "")))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for working tables in the shared folder that the session names; a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        return f"file://{tempfile.mkdtemp(prefix=f'{name}-')}"
    import uuid

    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Targeted reads --------------------------------------------------------------------------------
def batches(names: Iterable[str], size: int = BATCH) -> Iterator[list[str]]:
    wanted = sorted({n.strip().strip('"').lower() for n in names if n and n.strip()})
    for at in range(0, len(wanted), size):
        yield wanted[at : at + size]


def name_predicates(column: str, names: Iterable[str], size: int = BATCH, also: str = "") -> list[str]:
    """SQL conditions that together hold for the rows whose `column` is one of `names`; none where there are no names."""
    quoted = lambda n: "'" + n.replace("'", "''") + "'"
    return [f"LOWER({column}) IN ({', '.join(map(quoted, part))})" + (f" AND {also}" if also else "") for part in batches(names, size)]


def live_rows(spark: SparkSession, url: str, relation: str, column: str, names: Iterable[str], schema_column: str = "", schemas: Iterable[str] = (), **properties: str) -> DataFrame:
    """Rows of a live relation for some names: each batch is a predicate that the database evaluates, and a partition of the read."""
    within = " AND ".join(name_predicates(schema_column, schemas, MOST_NAMES)) if schema_column else ""
    predicates = name_predicates(column, names, also=within) or ["1 = 0"]
    return spark.read.jdbc(url, relation, predicates=predicates, properties=properties)


def for_names(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Rows whose `column` (kept plain) is among `names` (one column). Up to MOST_NAMES names go into the scan as a filter, whose file statistics then skip what holds none; beyond that the names are joined."""
    found = [r[0] for r in names.where(f"{names.columns[0]} is not null").distinct().limit(MOST_NAMES + 1).collect()]
    if len(found) > MOST_NAMES:
        return rows.join(names.select(F.col(names.columns[0]).alias(column)).distinct(), column, "left_semi")
    return rows.where(F.col(column).isin(sorted(found)))


class Repository:
    """Tables and columns of several databases in a Store: a slice for each database, a version for each build or upsert.

    tables: database_name, schema_name, table_name and any facts; columns: the same names with column_name, data_type, sortkey_pos."""

    TABLES, COLUMNS, SUFFIXES = "catalog_tables", "catalog_columns", "catalog_suffixes"

    def __init__(self, store: Store) -> None:
        self.store = store

    @staticmethod
    def _kept(rows: DataFrame) -> DataFrame:
        named = rows.withColumns({c: plain(c) for c in KEY}).where("table_name <> ''")
        return named.withColumns({"table_key": F.array_join(F.filter(F.array(*KEY), lambda x: x != ""), "."), "snapshot_id": F.lit("catalog"), "namespace_id": F.col("database_name")})

    @staticmethod
    def _suffixes(tables: DataFrame) -> DataFrame:
        """The index: schema.table and table of each table, with its key and database."""
        forms = F.array_distinct(F.array(F.array_join(F.filter(F.array("schema_name", "table_name"), lambda x: x != ""), "."), F.col("table_name")))
        return tables.select("snapshot_id", "namespace_id", "database_name", "table_key", F.explode(forms).alias("suffix")).sortWithinPartitions("suffix")

    def build(self, tables: DataFrame, columns: DataFrame) -> int:
        """Takes the place of all that was kept before of the databases in `tables`; returns the version."""
        kept = self._kept(tables)
        self.store.replace_all({self.TABLES: kept, self.COLUMNS: self._kept(columns), self.SUFFIXES: self._suffixes(kept)})
        return self.store.versions()[-1]

    def upsert(self, tables: DataFrame, columns: DataFrame) -> int:
        """Writes tables through: they and their columns take the place of those of the same key; returns the version."""
        kept = self._kept(tables)
        if kept.isEmpty():
            return self.store.manifest()["number"]
        keys, slices = kept.select("table_key").distinct(), kept.select("namespace_id").distinct()
        new = {self.TABLES: kept, self.COLUMNS: self._kept(columns).join(keys, "table_key", "left_semi"), self.SUFFIXES: self._suffixes(kept)}
        merged = {}
        for name, rows in new.items():
            if self.store.exists(name):
                old = self.store.read(name).join(slices, "namespace_id", "left_semi").join(keys, "table_key", "left_anti")
                rows = old.unionByName(rows, allowMissingColumns=True)
            merged[name] = rows
        self.store.replace_all(merged)
        return self.store.versions()[-1]

    def stats(self, version: int | None = None) -> dict[str, int]:
        t, c = self.store.read(self.TABLES, version), self.store.read(self.COLUMNS, version)
        databases, tables = t.agg(F.countDistinct("database_name"), F.count("*")).first()
        return {"databases": databases, "tables": tables, "columns": c.count()}

    def find(self, database: str = "", schema: str = "", table: str = "", version: int | None = None) -> DataFrame:
        """Tables by any of their names, with their columns in sort key order; a name left out matches all."""
        tables, columns = self.store.read(self.TABLES, version), self.store.read(self.COLUMNS, version)
        for c, value in zip(KEY, (database, schema, table), strict=True):
            if value:
                wanted = F.lit(value.strip().strip('"').lower())
                tables, columns = tables.where(F.col(c) == wanted), columns.where(F.col(c) == wanted)
        place = F.when(F.col("sortkey_pos") > 0, F.col("sortkey_pos")).otherwise(9999)
        per = columns.groupBy("table_key").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "column_name", "data_type"))).alias("columns"))
        return tables.join(per, "table_key", "left")

    def get(self, database: str, schema: str, table: str, version: int | None = None) -> DataFrame:
        """The one table of a full name, or no row."""
        return self.find(version=version).where((F.col("database_name") == database.lower()) & (F.col("schema_name") == schema.lower()) & (F.col("table_name") == table.lower()))

    def resolve(self, refs: DataFrame, default_database: str = "", version: int | None = None) -> DataFrame:
        """refs (identity) with table_key: database.schema.table as it is; shorter names in the default database if one table there has them, else if one table anywhere has them."""
        name = plain("identity")
        asked = refs.select("identity").distinct().withColumn("suffix", name)
        index = for_names(self.store.read(self.SUFFIXES, version), "suffix", asked.select("suffix"))
        own = F.when(F.col("database_name") == default_database.lower(), F.col("table_key"))
        owners = index.groupBy("suffix").agg(F.count("*").alias("n"), F.min("table_key").alias("any"), F.count(own).alias("n_own"), F.min(own).alias("own"))
        by_suffix = owners.select("suffix", F.when((F.lit(default_database) != "") & (F.col("n_own") == 1), F.col("own")).when(F.col("n") == 1, F.col("any")).alias("by_suffix"))
        parts = F.split("suffix", r"\.")
        full = for_names(self.store.read(self.TABLES, version), "table_key", asked.where(F.size(parts) >= 3).select("suffix")).select(F.col("table_key").alias("full"))
        short = asked.where(F.size(parts) < 3).join(by_suffix, "suffix", "left").select("identity", F.col("by_suffix").alias("table_key"))
        long = asked.where(F.size(parts) >= 3).join(full, F.col("suffix") == F.col("full"), "left").select("identity", F.col("full").alias("table_key"))
        found = short.unionByName(long).withColumnRenamed("identity", "_identity")
        return refs.join(found, F.col("identity").eqNullSafe(F.col("_identity")), "left").drop("_identity")

    def catalog_for(self, refs: DataFrame, default_database: str = "", version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(tables of the references that the repository knows, references that it lacks)."""
        found = self.resolve(refs, default_database, version)
        keys = found.select("table_key").where("table_key is not null").distinct()
        return for_names(self.store.read(self.TABLES, version), "table_key", keys), found.where("table_key is null").drop("table_key")

    def fetch(self, refs: DataFrame, live: Callable[[DataFrame], tuple[DataFrame, DataFrame]], default_database: str = "") -> DataFrame:
        """refs with table_key and origin: from the repository, or from the live catalogue, which is asked for the missing names alone and written through.

        live: names (one column, table_name) -> (tables, columns)."""
        before = self.store.manifest()["number"]
        known = self.resolve(refs, default_database, before)
        missing = known.where("table_key is null").select(F.element_at(F.split(plain("identity"), r"\."), -1).alias("table_name")).where("table_name <> ''").distinct()
        self.upsert(*live(missing))
        again = self.resolve(refs.select("identity").distinct(), default_database).select(F.col("identity").alias("_again"), F.col("table_key").alias("later"))
        joined = known.join(again, F.col("identity").eqNullSafe(F.col("_again")), "left")
        origin = F.when(F.col("table_key").isNotNull(), "repository").when(F.col("later").isNotNull(), "live")
        return joined.withColumn("origin", origin).withColumn("table_key", F.coalesce("table_key", "later")).drop("later", "_again")
