"""The telemetry store: Parquet slices by snapshot and namespace, under a manifest of versions; storage operators and inventories."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.exprs import zero
from ..operators import rules

KEYS = ["snapshot_id", "namespace_id"]
EVIDENCE = ("query_history", "query_details", "query_health", "query_explain", "query_detail_flow", "query_text", "child_query_text", "table_scan_info")
SKEW_HOURS = 18


def stamped(rows: DataFrame, snapshot: str, namespace: str = "producer") -> DataFrame:
    """Snapshot and namespace on every row; a blank namespace becomes `namespace`."""
    have = F.trim(F.col("namespace_id").cast("string")) if "namespace_id" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("snapshot_id", F.lit(snapshot)).withColumn("namespace_id", F.coalesce(F.when(have != "", have), F.lit(namespace)))


def stored_value(c: str, kind: str) -> Column:
    """A value as the store keeps it: text, with NaN and null alike; bytes as UTF-8."""
    v = F.col(f"`{c}`")
    if kind in ("double", "float"):
        return F.when(~F.isnan(v), v.cast("string")).alias(c)
    return (F.decode(v, "UTF-8") if kind == "binary" else v.cast("string")).alias(c)


def stringified(rows: DataFrame) -> DataFrame:
    return rows.select(*[stored_value(c, t) for c, t in rows.dtypes])


def conformed(rows: DataFrame, expected: list[str]) -> DataFrame:
    """The expected columns, missing ones null, then the rest: tables evolve by adding columns."""
    rest = [c for c in rows.columns if c not in expected]
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in expected], *rest)


class Files:
    """The few file operations that a store needs, on whatever file system Hadoop reaches."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _of(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._of(path)
        return fs.exists(p)

    def matching(self, pattern: str) -> list[str]:
        fs, p = self._of(pattern)
        return [str(x.getPath().toString()) for x in fs.globStatus(p) or []]

    def text(self, path: str) -> str:
        fs, p = self._of(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def head(self, path: str, size: int) -> bytes:
        """The first bytes of a file, or of the first file with any of a folder or pattern."""
        fs, p = self._of(path)
        found = [x for top in fs.globStatus(p) or [] for x in (fs.listStatus(top.getPath()) if top.isDirectory() else [top])]
        for x in sorted((str(x.getPath().toString()) for x in found if x.getLen() and not str(x.getPath().getName()).startswith(("_", "."))), key=str):
            stream = fs.open(self.jvm.org.apache.hadoop.fs.Path(x))
            try:
                return bytes(stream.readNBytes(size))
            finally:
                stream.close()
        return b""

    def write(self, path: str, text: str) -> None:
        fs, p = self._of(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, source: str, target: str) -> None:
        """Renames a file to a name that must be free; raises Conflict where it is taken."""
        (_, p), (_, q) = self._of(source), self._of(target)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf)
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(p, q, none)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
                raise Conflict(target) from error
            raise

    def delete(self, path: str) -> None:
        fs, p = self._of(path)
        fs.delete(p, True)


class Conflict(Exception):
    """Another writer has committed since this one read the store."""


class Store:
    """Tables in slices (snapshot, namespace), under a manifest.

    A load writes its slices to a folder of its own. The manifest names the folder of every slice of every table; its
    versions are numbered files, and the highest counts. A commit writes the next version beside the others and
    renames it into place, so any number of tables change at once or not at all, and a writer that dies leaves what
    was there. Of two writers that start from one version the second raises Conflict. Renaming must be atomic and must
    refuse a taken name, as on HDFS; a manifest has one line per slice, so its size follows snapshots, not rows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def versions(self) -> list[int]:
        return sorted(int(x.rsplit("/", 1)[1].removesuffix(".json")) for x in self.files.matching(f"{self.root}/_manifest/[0-9]*.json"))

    def manifest(self, version: int | None = None) -> dict:
        """{number, tables: {table: {schema, slices: {slice: load}}}} of a version, or of the last."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        elif version not in known:
            raise ValueError(f"the store has no version {version}")
        return json.loads(self.files.text(f"{self.root}/_manifest/{version:09d}.json")) if version else {"number": 0, "tables": {}}

    def commit(self, base: dict, tables: dict[str, dict]) -> int:
        """Makes `tables` the state of theirs in the version after `base`."""
        number = base["number"] + 1
        passing = f"{self.root}/_manifest/_{uuid.uuid4().hex}.json"
        self.files.write(passing, json.dumps({"number": number, "tables": base["tables"] | tables}))
        try:
            self.files.publish(passing, f"{self.root}/_manifest/{number:09d}.json")
        except Conflict:
            self.files.delete(passing)
            raise
        return number

    def load(self, table: str, rows: DataFrame) -> dict:
        """Writes rows to a folder of their own, which no reader sees before a commit; returns the table's entry for them alone."""
        name = uuid.uuid4().hex
        # slices are gathered, and large ones split again by adaptive execution, so no slice is one task's work
        keyed = rows.withColumns({f"_{k}": F.col(k) for k in KEYS}).hint("rebalance", *KEYS)
        keyed.write.partitionBy(*[f"_{k}" for k in KEYS]).parquet(f"{self.root}/_data/{table}/{name}")
        found = self.files.matching(f"{self.root}/_data/{table}/{name}/_{KEYS[0]}=*/_{KEYS[1]}=*")
        return {"schema": rows.schema.json(), "slices": {"/".join(x.split("/")[-2:]): name for x in found}}

    @staticmethod
    def _with(entry: dict | None, new: dict) -> dict:
        """A table's entry with the slices of `new` in place of its own, and the columns of both."""
        if entry is None:
            return new
        both = {f["name"]: f for x in (entry, new) for f in json.loads(x["schema"])["fields"]}
        return {"schema": json.dumps({"type": "struct", "fields": list(both.values())}), "slices": entry["slices"] | new["slices"]}

    def exists(self, table: str) -> bool:
        return table in self.manifest()["tables"]

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as the last version has it, or an earlier one; columns that a slice lacks are null."""
        entry = self.manifest(version)["tables"].get(table)
        if entry is None:
            raise ValueError(f"the store has no table {table}")
        schema = StructType.fromJson(json.loads(entry["schema"]))
        paths = [f"{self.root}/_data/{table}/{load}/{name}" for name, load in sorted(entry["slices"].items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, table: str, rows: DataFrame) -> bool:
        """Replaces the slices (snapshot, namespace) that `rows` has; an empty frame replaces nothing. Says whether it wrote."""
        return self.replace_all({table: rows}) == [table]

    def replace_all(self, tables: dict[str, DataFrame]) -> list[str]:
        """replace() of several tables at once, in one version; returns those that had rows."""
        base = self.manifest()
        loads = {t: self.load(t, rows) for t, rows in tables.items()}
        loads = {t: entry for t, entry in loads.items() if entry["slices"]}
        if loads:
            self.commit(base, {t: self._with(base["tables"].get(t), entry) for t, entry in loads.items()})
        return list(loads)

    def append(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        """Rows take the place of stored rows equal in the keys (null-safe), within the touched slices only."""
        if not self.exists(table):
            self.replace(table, rows)
            return
        touched = rows.select(*KEYS).distinct()
        self.replace(table, upserted(self.read(table).join(touched, KEYS, "left_semi"), rows, [*KEYS, *keys]))

    def stage(self, table: str, rows: DataFrame) -> str:
        path = f"{self.root}/_staging/{table}"
        rows.write.mode("overwrite").parquet(path)
        return path

    def promote(self, snapshot: str, tables: list[str]) -> list[str]:
        """Staged tables that carry exactly this snapshot replace their slices, all in one version; returns the refused ones, which refuse all."""
        refused, staged = [], {}
        for t in tables:
            if not self.files.exists(self.path(f"_staging/{t}")):
                refused.append(t)
                continue
            staged[t] = self.spark.read.parquet(self.path(f"_staging/{t}"))
            if [r[0] for r in staged[t].select("snapshot_id").distinct().limit(2).collect()] != [snapshot]:
                refused.append(t)
        if not refused:
            self.replace_all(staged)
        return refused

    def backup(self, to: str, tables: list[str]) -> dict[str, int]:
        """Copies tables and returns the rows of each copy, read again; what each should hold is noted beside them."""
        base, out, notes = self.manifest()["number"], {}, {}
        for t in tables:
            rows = self.read(t, base or None)
            rows.write.mode("overwrite").parquet(f"{to}/{t}")
            notes[t] = contents(rows)
            out[t] = contents(self.spark.read.schema(rows.schema).parquet(f"{to}/{t}"))[0]
        self.files.write(f"{to}/_contents.json", json.dumps(notes))
        return out

    def restore(self, source: str, tables: list[str]) -> dict[str, int]:
        """Puts back copies made by backup(), all in one version, and returns their rows.

        Copies are checked against the backup's note before anything is written, and what was written before it counts; either raises and leaves the tables as they are."""
        notes = json.loads(self.files.text(f"{source}/_contents.json"))
        copies = {t: self.spark.read.parquet(f"{source}/{t}") for t in tables}
        for t, copy in copies.items():
            if list(contents(copy)) != notes.get(t):
                raise ValueError(f"the copy of {t} does not read back whole")
        base, loads, out = self.manifest(), {}, {}
        for t, copy in copies.items():
            loads[t] = self.load(t, copy)
            paths = [f"{self.root}/_data/{t}/{load}/{name}" for name, load in loads[t]["slices"].items()]
            written = self.spark.read.schema(copy.schema).parquet(*paths) if paths else copy.limit(0)
            if list(contents(written)) != notes[t]:
                raise ValueError(f"{t} does not read back whole after the restore")
            out[t] = notes[t][0]
        self.commit(base, loads)
        return out

    def recover(self, tables: list[str]) -> list[str]:
        """After an interrupted load: tables that are missing come back from their staged form, if that carries exactly one snapshot."""
        back = {}
        for t in tables:
            if self.exists(t) or not self.files.exists(self.path(f"_staging/{t}")):
                continue
            staged = self.spark.read.parquet(self.path(f"_staging/{t}"))
            if staged.select("snapshot_id").distinct().limit(2).count() == 1:
                back[t] = staged
        return self.replace_all(back)

    def truncate_all(self, tables: list[str], preserved: tuple[str, ...] = ("roster",)) -> list[str]:
        """Empties all tables but the preserved ones, in one version; the columns stay. Returns the emptied."""
        base = self.manifest()
        gone = [t for t in tables if t not in preserved and t in base["tables"]]
        if gone:
            self.commit(base, {t: base["tables"][t] | {"slices": {}} for t in gone})
        return gone

    def truncate(self, table: str) -> None:
        self.truncate_all([table], ())

    def expire(self, keep: int = 2) -> int:
        """Deletes the versions before the last `keep`, and the loads that no version left names; returns how many loads. Not beside a running writer."""
        known = self.versions()
        for v in known[:-keep]:
            self.files.delete(f"{self.root}/_manifest/{v:09d}.json")
        used = {(t, load) for v in known[-keep:] for t, entry in self.manifest(v)["tables"].items() for load in entry["slices"].values()}
        gone = [x for x in self.files.matching(f"{self.root}/_data/*/*") if tuple(x.split("/")[-2:]) not in used]
        for x in gone:
            self.files.delete(x)
        return len(gone)

    def cached(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """An analysis kept under its key; made and written once."""
        if not self.files.exists(self.path(f"_analyses/{key}/_SUCCESS")):
            make().write.mode("overwrite").parquet(self.path(f"_analyses/{key}"))
        return self.spark.read.parquet(self.path(f"_analyses/{key}"))


def contents(rows: DataFrame) -> tuple[int, str]:
    """Rows and a digest of their values, in any order."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return n, str(total)


def upserted(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows without an equal key in `rows`, and `rows`."""
    k = rows.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return stored.join(k, same, "left_anti").unionByName(rows, allowMissingColumns=True)


def kept_queries(slow: DataFrame, most: int, least_s: float = 0.0) -> DataFrame:
    """Ids of the `most` worst queries at or above a runtime, by risk, spill and runtime."""
    return slow.where(zero("elapsed_s") >= least_s).orderBy(F.desc_nulls_last("risk_score"), F.desc_nulls_last("total_spill"), F.desc_nulls_last("elapsed_s"), "query_id").limit(most).select("query_id")


def trimmed(tables: dict[str, DataFrame], keep: DataFrame) -> dict[str, DataFrame]:
    return {t: df.join(keep, "query_id", "left_semi") if t in EVIDENCE else df for t, df in tables.items()}


def trim_preview(tables: dict[str, DataFrame], keep: DataFrame) -> DataFrame:
    """Rows before and after a trim, by table; one pass each."""
    out, k = None, keep.withColumn("_keep", F.lit(1))
    for t, df in tables.items():
        part = df.join(k, "query_id", "left").agg(F.count("*").alias("rows_before"), F.count("_keep").alias("rows_after")).select(F.lit(t).alias("table_name"), "rows_before", "rows_after")
        out = part if out is None else out.unionByName(part)
    return out


def inventory(tables: dict[str, DataFrame], now: Column, fresh_hours: float = 24.0) -> DataFrame:
    """Rows, snapshots, last capture and freshness of each table (columns snapshot_id, captured_at)."""
    out = None
    for t, df in tables.items():
        part = df.agg(F.count("*").alias("row_count"), F.countDistinct("snapshot_id").alias("snapshots"), F.max("captured_at").alias("last_captured")).withColumn("table_name", F.lit(t))
        out = part if out is None else out.unionByName(part)
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_captured").cast("timestamp"))) / 3.6e9
    return out.withColumn("status", F.when(F.col("row_count") == 0, "empty").when(age <= fresh_hours, "fresh").otherwise("stale"))


def latest_sql(log: DataFrame) -> DataFrame:
    """The last recorded hash of each table's source SQL."""
    return log.groupBy("table_name").agg(F.max_by("sql_hash", F.struct("recorded_at", "sql_hash")).alias("sql_hash"))


def gated(sources: DataFrame) -> DataFrame:
    """Why a source may not be merged: not found, not promoted, or older than the newest by more than SKEW_HOURS."""
    newest = F.max("captured_at").over(W.partitionBy())  # a handful of sources
    age = (F.unix_micros(newest.cast("timestamp")) - F.unix_micros(F.col("captured_at").cast("timestamp"))) / 3.6e9
    return sources.withColumn("refusal", F.when(F.col("captured_at").isNull(), "missing").when(~F.col("promoted"), "unpromoted").when(age > SKEW_HOURS, "stale"))


def merged(sources: list[DataFrame], snapshot: str) -> DataFrame:
    """The sources' rows under one snapshot; each namespace comes from the first source that has it."""
    both = None
    for k, s in enumerate(sources):
        part = s.withColumn("_ord", F.lit(k))
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    first = both.groupBy("namespace_id").agg(F.min("_ord").alias("_ord"))
    return both.join(first, ["namespace_id", "_ord"], "left_semi").drop("_ord").withColumn("snapshot_id", F.lit(snapshot))


def cache_merged(cache: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A cache with later rows in place of earlier ones."""
    return cache.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def assigned(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Engineer and associated user by key; a change sets what it names, and a row with neither goes."""
    c = changes.select("assignment_key", F.col("engineer").alias("e"), F.col("associated_user").alias("u"))
    both = stored.join(c, "assignment_key", "full_outer")
    out = both.select("assignment_key", F.coalesce("e", "engineer").alias("engineer"), F.coalesce("u", "associated_user").alias("associated_user"))
    clean = lambda n: F.when(F.trim(n) != "", F.trim(n))
    return out.withColumn("engineer", clean("engineer")).withColumn("associated_user", clean("associated_user")).where("engineer is not null or associated_user is not null")


def ownership(rows: DataFrame) -> DataFrame:
    """Ids and users seen of each key by cluster."""
    return rows.groupBy("assignment_key", "namespace_id").agg(F.count("*").alias("queries"), F.array_sort(F.collect_set("user_name")).alias("users"), F.min("query_id").alias("first_id"), F.max("query_id").alias("last_id"))


def analysis_key(settings: dict[str, object], identities: DataFrame) -> str:
    """Digest of settings and of the identities (rows in any order) that an analysis was made from."""
    seen = identities.agg(F.count("*"), F.sum(F.xxhash64(*identities.columns).cast("decimal(38,0)"))).first()
    return hashlib.sha256(json.dumps([sorted(settings.items()), [str(v) for v in seen]], default=str).encode()).hexdigest()[:32]


def sql_drift(tables: DataFrame, log: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether each table was loaded by the SQL that is expected now: current, changed or unrecorded."""
    known = tables.select("table_name").join(latest_sql(log), "table_name", "left").join(expected.select("table_name", F.col("sql_hash").alias("expected_hash")), "table_name", "left")
    return known.withColumn("sql_status", F.when(F.col("sql_hash").isNull() | F.col("expected_hash").isNull(), "unrecorded").when(F.col("sql_hash") == F.col("expected_hash"), "current").otherwise("changed"))


def summary(slow: DataFrame, tables: DataFrame, reviewed: DataFrame) -> DataFrame:
    """One row: how many queries, tables, findings and actions a report has, and their extremes.

    What the rules find of a query or table is counted in its own row, so each of the three frames is read once."""
    critical = lambda h: F.size(F.filter(h, lambda x: x["severity"] == "crit"))
    raw = slow.withColumn("_raw", F.struct("elapsed_s", "risk_score", "total_spill"))
    per = rules.query_operands(raw).select("_raw.*", rules.hits(rules.QUERY_RULES).alias("found"), rules.hits(rules.QUERY_ACTIONS).alias("acts"), rules.hits(rules.REWRITE_RULES).alias("rewrites"))
    acts = F.size("acts") + F.size(F.filter("rewrites", lambda x: x["impact_score"] >= 80))
    q = per.agg(
        F.count("*").alias("queries"), F.sum(zero("elapsed_s")).alias("total_elapsed_s"), F.max("risk_score").alias("max_risk"), F.sum(F.when(zero("total_spill") > 0, 1).otherwise(0)).alias("spilling_queries"),
        zero(F.sum(F.size("found"))).alias("_found"), zero(F.sum(critical("found"))).alias("_critical"), zero(F.sum(acts)).alias("_acts"),
    )
    per = rules.table_operands(tables).select("table_risk_score", rules.hits(rules.TABLE_RULES).alias("found"))
    t = per.agg(F.count("*").alias("tables"), F.sum(F.when(F.col("table_risk_score") >= 50, 1).otherwise(0)).alias("high_risk_tables"), zero(F.sum(F.size("found"))).alias("_t_found"), zero(F.sum(critical("found"))).alias("_t_critical"))
    r = rules.table_operands(reviewed).agg(zero(F.sum(F.size(rules.hits(rules.TABLE_ACTIONS)))).alias("_t_acts"))
    both = q.crossJoin(t).crossJoin(r)  # a row each
    counts = {"findings": "found", "critical_findings": "critical", "actions": "acts"}
    return both.select("queries", "total_elapsed_s", "max_risk", "spilling_queries", "tables", "high_risk_tables", *[(F.col(f"_{c}") + F.col(f"_t_{c}")).alias(k) for k, c in counts.items()])


def markdown(rows: DataFrame, title: str) -> str:
    """A frame as a Markdown table: every row; one partition at a time comes to the driver."""
    names = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " - |" * len(names)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows.toLocalIterator()]
    return "\n".join(lines) + "\n"


def coverage(history: DataFrame) -> DataFrame:
    """First and last start and distinct queries per namespace."""
    return history.groupBy("namespace_id").agg(F.count("*").alias("row_count"), F.countDistinct("query_id").alias("queries"), F.min("start_time").alias("first_start"), F.max("start_time").alias("last_start"))


def histogram(rows: DataFrame, time: str, buckets: int = 64) -> DataFrame:
    """Counts in equal-width buckets of time; the ends come from one aggregate, joined back as a single row."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    timed = rows.where(F.col(time).isNotNull()).select(t.alias("t"))
    ends = timed.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    low, span = ends["low"] or 0, max((ends["high"] or 0) - (ends["low"] or 0), 1)
    bucket = F.least(F.floor((F.col("t") - low) * buckets / F.lit(span)), F.lit(buckets - 1)).cast("long")
    return timed.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def gaps(found: DataFrame, buckets: int = 64, least: int = 2) -> DataFrame:
    """Runs of at least `least` empty buckets (islands over at most `buckets` rows)."""
    spark = found.sparkSession
    empty = spark.range(buckets).withColumnRenamed("id", "bucket").join(found, "bucket", "left_anti")
    run = empty.withColumn("island", F.col("bucket") - F.row_number().over(W.orderBy("bucket")))
    return run.groupBy("island").agg(F.min("bucket").alias("first_bucket"), F.count("*").alias("length")).where(F.col("length") >= least).drop("island")


def cluster_severity(clusters: DataFrame) -> DataFrame:
    """disabled, complete, red or amber, by enabled, expected and loaded tables."""
    return clusters.withColumn("severity", F.when(~F.col("enabled"), "disabled").when(F.col("loaded") >= F.col("expected"), "complete").when(F.col("loaded") * 2 < F.col("expected"), "red").otherwise("amber"))


def health_checks(history: DataFrame, steps: DataFrame, texts: DataFrame) -> DataFrame:
    """Checks (check_name, value, status): volumes, coverage by steps and texts, placeholder users."""
    base = history.agg(F.count("*").alias("n"), F.sum(F.when(F.coalesce(F.trim("user_name"), F.lit("")).isin("", "unknown", "None"), 1).otherwise(0)).alias("anonymous")).first()
    with_steps = history.join(steps.select("query_id").distinct(), "query_id", "left_semi").count()
    with_text = history.join(texts.select("query_id").distinct(), "query_id", "left_semi").count()
    n = base["n"] or 0
    pct = lambda k: 100.0 * (k or 0) / n if n else 0.0
    rows = [("history_rows", float(n), "ok" if n else "fail"), ("step_coverage_pct", pct(with_steps), "ok" if pct(with_steps) >= 80 else "warn"), ("text_coverage_pct", pct(with_text), "ok" if pct(with_text) >= 80 else "warn"), ("placeholder_user_pct", pct(base["anonymous"]), "warn" if pct(base["anonymous"]) > 20 else "ok")]
    return history.sparkSession.createDataFrame(rows, "check_name string, value double, status string")


def roster(users: DataFrame) -> DataFrame:
    """Names of `IAM:first.middle.last@domain` accounts, one row per account."""
    raw = F.lower(F.trim("user_name"))
    mail = F.regexp_extract(raw, r"([a-z0-9._%+-]+@[a-z0-9.-]+)", 1)
    local = F.substring_index(mail, "@", 1)
    part = F.filter(F.split(local, r"\."), lambda x: x != "")
    n = F.size(part)
    return (
        users.where(mail != "").select(raw.alias("account"), mail.alias("email"), F.get(part, F.lit(0)).alias("first_name"), F.when(n > 2, F.array_join(F.slice(part, F.lit(2), n - 2), " ")).alias("middle_name"), F.when(n > 1, F.element_at(part, -1)).alias("last_name"), F.substring_index(mail, "@", -1).alias("domain")).dropDuplicates(["account"])
    )


def attached(rows: DataFrame, found: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a looked-up display name, or the key's own text."""
    look = found.select(F.lower(F.trim(F.col(key))).alias("_k"), F.col(name).alias("_n")).dropDuplicates(["_k"])
    return rows.join(look, F.lower(F.trim(F.col(key))) == F.col("_k"), "left").withColumn(name, F.coalesce("_n", F.col(key).cast("string"))).drop("_k", "_n")
