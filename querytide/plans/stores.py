"""Queries over capture filters, storage operators and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..sources import capture, storage
from ..sources.adapter import relation, table, with_
from . import core
from .core import duration_sql, near_sql, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


RAW = "raw as (select p_partkey as id, case p_partkey % 9 when 0 then ' None ' when 1 then 'NULL' when 2 then '' when 3 then '1.5' when 4 then '1e3' when 5 then cast(p_partkey as varchar(20)) when 6 then '-2.25' when 7 then ' 7 ' else 'x' || cast(p_partkey as varchar(20)) end as v, cast(p_partkey as bigint) * 1000003 as d from {part})"


def _raw(spark, sf) -> DataFrame:
    return spark.sql(f"with {RAW.format(part=f'parquet.`{sf}/part.parquet`')} select * from raw")


_TOKEN = "nullif(nullif(nullif(trim(v), ''), 'None'), 'NULL')"


@query("typed_values", f"with {RAW.format(part='part')} select id, {_TOKEN} as token, try_cast({_TOKEN} as bigint) as whole, {near_sql(f'try_cast({_TOKEN} as double)', 4)} as real_value, case when trim(v) not in ('', 'None', 'NULL') then v end as fragment, {near_sql(duration_sql('d'), 4)} as seconds from raw")
def typed_values(spark, sf):
    found = _raw(spark, sf).select("id", exprs.token("v").alias("token"), exprs.whole("v").alias("whole"), exprs.real("v").alias("real_value"), exprs.fragment("v").alias("fragment"), exprs.duration_seconds("d").alias("seconds"))
    return rounded(found, "real_value", "seconds", digits=4)


@query("missing_keys", f"{with_('tables')} select table_id, {core._MISSING} as by_sql, regexp_replace(lower(trim(coalesce(sortkey1, ''))), '\\s+', '', 'g') in ({', '.join(repr(x) for x in exprs.MISSING_KEY_META)}) as by_meta, nullif(regexp_extract(lower(diststyle), 'key\\s*\\(?\\s*([a-z_][a-z0-9_$]*)', 1), '') as distkey from tables")
def missing_keys(spark, sf):
    return relation(spark, sf, "tables").select("table_id", exprs.missing_sortkey("sortkey1").alias("by_sql"), exprs.missing_key("sortkey1").alias("by_meta"), exprs.distkey("diststyle").alias("distkey"))


@query("elapsed_seconds", f"{with_('history')} select query_id, case when epoch_us(end_time) >= epoch_us(start_time) then {near_sql('(epoch_us(end_time)//1000 - epoch_us(start_time)//1000) / 1000.0', 3)} end as elapsed_s from history")
def elapsed_seconds(spark, sf):
    return rounded(relation(spark, sf, "history").select("query_id", exprs.elapsed_seconds("start_time", "end_time").alias("elapsed_s")), "elapsed_s", digits=3)


@query("step_categories", "with s as (select step_name, count(*) as n from (" + with_("steps") + " select * from steps) group by 1) select step_name, case when contains(step_name, 'join') then 'join' when contains(step_name, 'aggr') then 'aggregate' when contains(step_name, 'sort') then 'sort' when contains(step_name, 'scan') then 'scan' else 'other' end as category, n from s")
def step_categories(spark, sf):
    return relation(spark, sf, "steps").groupBy("step_name").agg(F.count("*").alias("n")).select("step_name", exprs.step_category("step_name").alias("category"), "n")


_NOW = "timestamp '1998-08-02 00:00:00'"


@query("capture_roots", f"{with_('history')} select query_id, execution_time from history where coalesce(execution_time, 0) / 1e6 >= 5000 and start_time >= {_NOW} - interval 8760 hour")
def capture_roots(spark, sf):
    return capture.roots(relation(spark, sf, "history"), 5000.0, hours=8760, now=F.lit("1998-08-02 00:00:00").cast("timestamp_ntz")).select("query_id", "execution_time")


@query("high_water", f"{with_('history')} select start_time, query_id from (select start_time, query_id from history where query_id % 2 = 0 union all select start_time, query_id from history where query_id % 3 = 0) order by start_time desc nulls last, query_id desc limit 1")
def high_water(spark, sf):
    h = relation(spark, sf, "history")
    return capture.high_water(h.where("query_id % 2 = 0"), h.where("query_id % 3 = 0"))


_MARK = "timestamp '1996-01-01 00:00:00'"


@query("incremental_rows", f"{with_('history')}, h as (select query_id, case when query_id % 50 = 0 then null else start_time end as start_time from history) select query_id, start_time from h where start_time > {_MARK} or (start_time = {_MARK} and query_id > 5000) or (start_time is null and query_id > 5000)")
def incremental_rows(spark, sf):
    h = relation(spark, sf, "history").select("query_id", F.when(F.col("query_id") % 50 != 0, F.col("start_time")).alias("start_time"))
    return capture.newer(h, F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"), F.lit(5000))


@query("target_fragments", f"{with_('fragments')} select query_id, sequence from fragments where query_id % 3 = 1")
def target_fragments(spark, sf):
    f = relation(spark, sf, "fragments")
    return capture.of_targets(f, f.where("query_id % 3 = 1")).select("query_id", "sequence")


@query("external_scope", f"{with_('externals')} select ext_id from externals where schema_name in ('spectrum_1', 'spectrum_2') and (table_name like 'ext!_1%' escape '!' or table_name like 'ext!__' escape '!')")
def external_scope(spark, sf):
    return relation(spark, sf, "externals").where(capture.external_scope(["Spectrum_1", "spectrum_2"], ["ext_1*", "ext_?"])).select("ext_id")


@query("namespace_floors", f"{with_('history')} select query_id, namespace_id from history where elapsed_time / 1e6 >= case namespace_id when 'ns0' then 100000 when 'ns1' then 200000 else 0 end")
def namespace_floors(spark, sf):
    h = relation(spark, sf, "history").withColumn("elapsed_s", F.col("elapsed_time") / 1e6)
    return capture.above_floors(h, {"ns0": 100_000.0, "ns1": 200_000.0}).select("query_id", "namespace_id")


@query("scoped_rows", f"{with_('history')} select namespace_id, count(*) as n from history where query_id % 2 = 1 and namespace_id in ('ns1', 'ns3') group by 1")
def scoped_rows(spark, sf):
    h = relation(spark, sf, "history").withColumn("snapshot_id", F.concat(F.lit("s"), (F.col("query_id") % 2).cast("string")))
    return capture.in_scope(h, "s1", ["ns1", "ns3"]).groupBy("namespace_id").agg(F.count("*").alias("n"))


@query("append_dedupe", f"{with_('history')} select query_id, namespace_id, elapsed_time from history where query_id % 3 <> 0 and query_id % 2 <> 0 union all select query_id, namespace_id, elapsed_time + 1 from history where query_id % 2 = 0")
def append_dedupe(spark, sf):
    h = relation(spark, sf, "history").select("query_id", "namespace_id", "elapsed_time")
    return storage.upserted(h.where("query_id % 3 <> 0"), h.where("query_id % 2 = 0").withColumn("elapsed_time", F.col("elapsed_time") + 1), ["query_id", "namespace_id"])


@query("evidence_trim", f"{with_(*core.BASE)}, {core.SLOW}, keep as (select query_id from (select query_id, {near_sql('risk_score')} as risk_score, total_spill, {near_sql('elapsed_s', 4)} as elapsed_s from slow where coalesce(elapsed_s, 0) >= 100) order by risk_score desc nulls last, total_spill desc nulls last, elapsed_s desc nulls last, query_id limit 1000) select 'query_details' as table_name, count(*) as rows_before, count(keep.query_id) as rows_after from steps left join keep using (query_id) union all select 'query_explain', count(*), count(keep.query_id) from plans left join keep using (query_id)")
def evidence_trim(spark, sf):
    s = core.slow(spark, sf).where("coalesce(elapsed_s, 0) >= 100")
    keep = storage.kept_queries(rounded(s, "risk_score").withColumn("elapsed_s", core.near("elapsed_s", 4)), 1000)
    return storage.trim_preview({"query_details": relation(spark, sf, "steps"), "query_explain": relation(spark, sf, "plans")}, keep)


_LOG = "log as (select 'table_' || cast(o_custkey % 40 as varchar(20)) as table_name, o_orderdate as recorded_at, md5(cast(o_custkey as varchar(20))) as sql_hash from {orders} where o_custkey % 40 <> 7)"
_LOADED = "loaded as (select distinct 'table_' || cast(o_custkey % 40 as varchar(20)) as table_name from {orders})"


@query("sql_drift", f"with {_LOG}, {_LOADED}, l as (select table_name, arg_max(sql_hash, strftime(recorded_at, '%Y-%m-%d %H:%M:%S') || sql_hash) as sql_hash from log group by 1) select table_name, case when l.sql_hash is null or table_name like '%3' then 'unrecorded' when table_name like '%1' then 'current' else 'changed' end as sql_status from loaded left join l using (table_name)".replace("{orders}", "orders"))
def sql_drift(spark, sf):
    read = lambda text, name: spark.sql(f"with {text} select * from {name}".replace("{orders}", f"parquet.`{sf}/orders.parquet`"))
    log, loaded = read(_LOG, "log"), read(_LOADED, "loaded")
    expected = storage.latest_sql(log).where("table_name not like '%3'").withColumn("sql_hash", F.when(F.col("table_name").like("%1"), F.col("sql_hash")).otherwise("other"))
    return storage.sql_drift(loaded, log, expected).select("table_name", "sql_status")


@query("table_inventory", f"{with_('history')} select 'a' as table_name, count(*) as row_count, count(distinct query_id % 4) as snapshots, max(start_time) as last_captured, case when (epoch_us({_NOW}) - epoch_us(max(start_time))) / 3.6e9 <= 24 then 'fresh' else 'stale' end as status from history union all select 'b', count(*), count(distinct query_id % 4), max(start_time), case when count(*) = 0 then 'empty' else 'stale' end from history where start_time < timestamp '1995-01-01'")
def table_inventory(spark, sf):
    h = relation(spark, sf, "history").select((F.col("query_id") % 4).alias("snapshot_id"), F.col("start_time").alias("captured_at"))
    return storage.inventory({"a": h, "b": h.where("captured_at < timestamp_ntz '1995-01-01'")}, F.lit("1998-08-02 00:00:00").cast("timestamp_ntz"))


@query("latest_sql_hash", f"{with_('history')} select database_name as table_name, arg_max(md5(cast(query_id as varchar)), (start_time, query_id)) as sql_hash from history group by 1")
def latest_sql_hash(spark, sf):
    h = relation(spark, sf, "history")
    log = h.select(F.col("database_name").alias("table_name"), F.md5(F.col("query_id").cast("string")).alias("sql_hash"), F.struct("start_time", "query_id").alias("recorded_at"))
    return storage.latest_sql(log)


@query("warehouse_merge", f"{with_('history')}, s as (select *, 0 as o from history where namespace_id in ('ns0', 'ns1') union all select *, 1 from history where namespace_id in ('ns1', 'ns2', 'ns3') and query_id % 2 = 0) select namespace_id, 'm1' as snapshot_id, count(*) as n, min(query_id) as first_id from s where o = (select min(o) from s t where t.namespace_id = s.namespace_id) group by namespace_id")
def warehouse_merge(spark, sf):
    h = relation(spark, sf, "history")
    found = storage.merged([h.where("namespace_id in ('ns0', 'ns1')"), h.where("namespace_id in ('ns1', 'ns2', 'ns3') and query_id % 2 = 0")], "m1")
    return found.groupBy("namespace_id", "snapshot_id").agg(F.count("*").alias("n"), F.min("query_id").alias("first_id"))


@query("history_coverage", f"{with_('history')} select namespace_id, count(*) as row_count, count(distinct query_id) as queries, min(start_time) as first_start, max(start_time) as last_start from history group by 1")
def history_coverage(spark, sf):
    return storage.coverage(relation(spark, sf, "history"))


_HIST = "e as (select epoch_us(ts) as t from events), b as (select least(floor((t - (select min(t) from e)) * 64 / cast((select max(t) - min(t) from e) as double)), 63) as bucket from e), hist as (select cast(bucket as bigint) as bucket, count(*) as n from b group by 1)"


@query("time_histogram", f"with {_HIST} select * from hist")
def time_histogram(spark, sf):
    return storage.histogram(table(spark, sf, "events"), "ts")


@query("histogram_gaps", "with e as (select o_orderkey % 64 as bucket from orders where o_orderkey % 64 not in (3, 4, 5, 10, 40, 41) group by 1), m as (select r as bucket from range(64) t(r) where r not in (select bucket from e)), g as (select bucket, bucket - row_number() over (order by bucket) as island from m) select min(bucket) as first_bucket, count(*) as length from g group by island having count(*) >= 2")
def histogram_gaps(spark, sf):
    found = table(spark, sf, "orders").where("o_orderkey % 64 not in (3, 4, 5, 10, 40, 41)").groupBy((F.col("o_orderkey") % 64).alias("bucket")).agg(F.count("*").alias("n"))
    return storage.gaps(found)


@query("user_roster", f"{with_('users')} select distinct lower(trim(user_name)) as account, split_part(lower(trim(user_name)), ':', 2) as email, split_part(split_part(lower(trim(user_name)), ':', 2), '.', 1) as first_name, split_part(lower(trim(user_name)), '.', 2) as middle_name, 'smith' as last_name, 'corp.example' as domain from users")
def user_roster(spark, sf):
    return storage.roster(relation(spark, sf, "users"))


@query("ownership", f"{with_('history')} select database_name as assignment_key, namespace_id, count(*) as queries, array_to_string(list_sort(list(distinct user_name)), ',') as users, min(query_id) as first_id, max(query_id) as last_id from history group by all")
def ownership(spark, sf):
    h = relation(spark, sf, "history").withColumnRenamed("database_name", "assignment_key")
    return storage.ownership(h).withColumn("users", F.array_join("users", ","))


@query("assignments", f"{with_('history')}, s as (select query_id as k, user_name as e, 'u' as u from history where query_id % 2 = 0), c as (select query_id as k, case when query_id % 5 = 0 then '' else 'x' end as e, case when query_id % 5 = 0 then '' end as u from history where query_id % 3 = 0), m as (select coalesce(s.k, c.k) as k, coalesce(c.e, s.e) as e, coalesce(c.u, s.u) as u from s full outer join c on s.k = c.k) select k as assignment_key, nullif(trim(e), '') as engineer, nullif(trim(u), '') as associated_user from m where nullif(trim(e), '') is not null or nullif(trim(u), '') is not null")
def assignments(spark, sf):
    h = relation(spark, sf, "history")
    stored = h.where("query_id % 2 = 0").select(F.col("query_id").alias("assignment_key"), F.col("user_name").alias("engineer"), F.lit("u").alias("associated_user"))
    changes = h.where("query_id % 3 = 0").select(F.col("query_id").alias("assignment_key"), F.when(F.col("query_id") % 5 == 0, "").otherwise("x").alias("engineer"), F.when(F.col("query_id") % 5 == 0, "").alias("associated_user"))
    return storage.assigned(stored, changes)


@query("health_checks", f"{with_('history', 'steps', 'statements')}, n as (select count(*) as n, count(*) filter (trim(user_name) in ('', 'unknown', 'None')) as a, count(*) filter (query_id in (select query_id from steps)) as s, count(*) filter (query_id in (select query_id from statements)) as t from history) select 'history_rows' as check_name, cast(n as double) as value, 'ok' as status from n union all select 'step_coverage_pct', 100.0 * s / cast(n as double), case when 100.0 * s / n >= 80 then 'ok' else 'warn' end from n union all select 'text_coverage_pct', 100.0 * t / cast(n as double), case when 100.0 * t / n >= 80 then 'ok' else 'warn' end from n union all select 'placeholder_user_pct', 100.0 * a / cast(n as double), case when 100.0 * a / n > 20 then 'warn' else 'ok' end from n")
def health_checks(spark, sf):
    return storage.health_checks(relation(spark, sf, "history"), relation(spark, sf, "steps"), relation(spark, sf, "statements"))


@query("cache_merge", f"{with_('history')} select query_id, 'new' as v from history where query_id % 3 = 0 union all select query_id, 'old' from history where query_id % 3 <> 0 and query_id % 2 = 0")
def cache_merge(spark, sf):
    h = relation(spark, sf, "history")
    return storage.cache_merged(h.where("query_id % 2 = 0").select("query_id", F.lit("old").alias("v")), h.where("query_id % 3 = 0").select("query_id", F.lit("new").alias("v")), "query_id")


@query("merge_gate", f"{with_('history')}, s as (select namespace_id, max(start_time) - (cast(right(namespace_id, 1) as integer) * 10) * interval 1 hour as captured_at, namespace_id <> 'ns1' as promoted from history group by 1) select namespace_id, case when not promoted then 'unpromoted' when (epoch_us((select max(captured_at) from s)) - epoch_us(captured_at)) / 3.6e9 > 18 then 'stale' end as refusal from s")
def merge_gate(spark, sf):
    s = relation(spark, sf, "history").groupBy("namespace_id").agg(F.max("start_time").alias("m")).select("namespace_id", (F.col("m") - F.expr("make_dt_interval(0, cast(right(namespace_id, 1) as int) * 10, 0, 0)")).alias("captured_at"), (F.col("namespace_id") != "ns1").alias("promoted"))
    return storage.gated(s).select("namespace_id", "refusal")


@query("display_names", f"{with_('history')} select query_id, case namespace_id when 'ns0' then 'Producer' when 'ns1' then 'Consumer' else namespace_id end as display_name from history")
def display_names(spark, sf):
    names = spark.createDataFrame([("NS0", "Producer"), ("ns1 ", "Consumer")], "namespace_id string, display_name string")
    return storage.attached(relation(spark, sf, "history").select("query_id", "namespace_id"), names, "namespace_id", "display_name").select("query_id", "display_name")


@query("snapshot_generator")
def snapshot_generator(spark, sf):
    return capture.snapshot(spark)["history"]
