"""Queries of lookups, memberships and view filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import external, grouping, lookups, rules
from ..sources import storage
from ..sources.adapter import relation, with_
from . import core, externals, groups
from .core import near_sql, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


@query("group_hydration", f"{with_('history')} select h.query_id, h.namespace_id, case when h.query_id % 3 = 0 then h.elapsed_time + 5 else h.elapsed_time end as elapsed_time from history h")
def group_hydration(spark, sf):
    h = relation(spark, sf, "history").select("query_id", "namespace_id", "elapsed_time")
    return lookups.hydrated(h, h.where("query_id % 3 = 0").withColumn("elapsed_time", F.col("elapsed_time") + 5), ["elapsed_time"])


@query("first_wins_names", f"{with_('tables')}, t as (select table_id % 100 as stem, min(table_id) as table_id from tables group by 1) select 'name_' || cast(stem as varchar) as suffix, table_id from t")
def first_wins_names(spark, sf):
    t = relation(spark, sf, "tables").select("table_id", F.concat(F.lit("name_"), (F.col("table_id") % 100).cast("string")).alias("table_key"))
    return lookups.first_wins(t, "table_id")


@query("group_table_sets", f"{with_('patterns')}, n as (select repeat_group_id, lower(unnest(string_split(sql_tables, ', '))) as name from patterns), c as (select repeat_group_id, count(*) as n, count(*) filter (name like 'brand!_1%' escape '!') as e, count(*) filter (name = 'other.unknown') as v from n group by 1) select repeat_group_id, case when e = 0 then 'local' when e = n then 'external' else 'mixed' end as table_set, v > 0 as uses_views, e as external_tables from c")
def group_table_sets(spark, sf):
    g = relation(spark, sf, "patterns")
    names = g.select(F.explode(F.split("sql_tables", ", ")).alias("name"))
    return lookups.table_sets(g, names.where("name like 'brand!_1%' escape '!'"), names.where("name = 'other.unknown'"))


_VIEWS = "v as (select 'db.s.view_' || cast(s_suppkey as varchar(20)) as view_key, 'select a from spectrum_' || cast(s_suppkey%4 as varchar(20)) || '.ext_' || cast(s_suppkey as varchar(20)) || ' join local_t t on t.a = 1' as source_definition from {supplier})"


@query("views_over_external_tables", f"{with_('externals')}, {_VIEWS.replace('{supplier}', 'supplier')} select view_key, 'spectrum_' || cast(ext_id % 4 as varchar) || '.ext_' || cast(ext_id as varchar) as external_tables from v join externals on view_key = 'db.s.view_' || cast(ext_id as varchar)")
def views_over_external_tables(spark, sf):
    v = spark.sql(f"with {_VIEWS.replace('{supplier}', f'parquet.`{sf}/supplier.parquet`')} select * from v")
    found = lookups.external_views(v, external.catalog_keyed(relation(spark, sf, "externals")))
    return found.select("view_key", F.array_join("external_tables", ",").alias("external_tables"))


@query(
    "plan_node_matches",
    f"""{with_("plans", "steps")}, j as (select query_id, 1 as join_no, 't' as target from plans group by 1), e as (select query_id, plan_node_id, lower(plan_node || ' ' || plan_info) as node from plans),
 s as (select j.query_id, join_no, plan_node_id, case when contains(node, 't') then 3 else 0 end + case when regexp_matches(node, 'hash join|merge join|nested loop') then 2 else 0 end + case when contains(node, 'cond:') then 1 else 0 end as score from j join e using (query_id)),
 b as (select query_id, join_no, first(plan_node_id order by score desc, plan_node_id) as plan_node_id, max(score) as score from s group by all having max(score) >= 2),
 d as (select query_id, step_id as plan_node_id, cast(sum(output_rows) as bigint) as output_rows, cast(sum(spill_local + spill_remote) as bigint) as spill_blocks from steps group by all) select b.*, output_rows, spill_blocks from b left join d using (query_id, plan_node_id)""",
)
def plan_node_matches(spark, sf):
    p = relation(spark, sf, "plans")
    joins = p.select("query_id").distinct().selectExpr("query_id", "1 as join_no", "'' as left_column", "'' as right_column", "'t' as target")
    return lookups.plan_matches(joins, p, relation(spark, sf, "steps").withColumnRenamed("step_id", "plan_node_id"))


@query("recipients", f"{with_('users')} select distinct user_id, split_part(lower(user_name), ':', 2) as email from users")
def recipients(spark, sf):
    u = relation(spark, sf, "users").select("user_id", "user_name").distinct()
    return lookups.recipients(u, storage.roster(u)).select("user_id", "email")


@query("execution_evidence", f"{with_('steps')}, s as (select *, duration / cast(sum(duration) over (partition by query_id) as double) as share from steps) select table_id, count(*) as scans, cast(sum(input_rows) as bigint) as input_rows, max(data_skewness) as max_skew, cast(sum(spill_local + spill_remote) as bigint) as spill_blocks, {near_sql('max(share)')} as max_share from s group by 1")
def execution_evidence(spark, sf):
    return rounded(lookups.execution_evidence(relation(spark, sf, "steps")), "max_share")


@query("group_parents", f"{groups._W} select constraint_key, first(query_id order by elapsed_s desc, query_id) as query_id, count(*) as runs, {near_sql('avg(elapsed_s)', 3)} as elapsed_s from ck group by 1")
def group_parents(spark, sf):
    return rounded(lookups.parent_rows(grouping.candidates(groups.stated(spark, sf)), "constraint_key", ["elapsed_s"]), "elapsed_s", digits=3)


@query("heat_map_rows", f"{with_('tables')} select table_id, size_mb from tables where size_mb >= 100 and tbl_rows >= 50000000 and source_db = 'db1' and ({core._MISSING.replace('regexp_replace(upper', 'regexp_replace(upper')} or lower(sortkey1) = 'auto' or lower(sortkey1) in ('none', '', 'auto(sortkey)') or unsorted_pct >= 20 or stats_off >= 10 or skew_rows >= 4)")
def heat_map_rows(spark, sf):
    return lookups.filtered_tables(relation(spark, sf, "tables"), "DB1", None, 100, 50_000_000, True).select("table_id", "size_mb")


@query("external_search", f"{with_('externals')} select ext_id from externals where contains(lower(schema_name || ' ' || table_name || ' ' || location || ' ' || input_format), 'parquet')")
def external_search(spark, sf):
    return lookups.searched(relation(spark, sf, "externals"), " Parquet ", ["schema_name", "table_name", "location", "input_format"]).select("ext_id")


@query("external_focus", f"{externals._CHAIN}, {externals.OUT}, {externals.ISSUES} select ext_id, score from sc where score >= 45 and contains(codes, 'COLUMNAR_FORMAT')")
def external_focus(spark, sf):
    return lookups.focused(external.assessed(externals.starred(spark, sf)), "COLUMNAR_FORMAT", 45).select("ext_id", "score")


@query("external_heat_map", f"{externals._CHAIN} select ext_id, external_table_key, {near_sql('scan_gb', 3)} as scan_gb from ext where schema_name = 'spectrum_1' and coalesce(scan_gb, 0) >= 1 and coalesce(query_count, 0) >= 2 and (partition_keys <= 0 or coalesce(partition_pruning_pct, 0) < 50 or coalesce(warning_count, 0) > 0)")
def external_heat_map(spark, sf):
    found = lookups.filtered_external(externals.tables(spark, sf), "Spectrum_1", 1.0, 2, problems_only=True)
    return rounded(found.select("ext_id", "external_table_key", "scan_gb"), "scan_gb", digits=3)


@query("group_query_ids", f"{groups._W} select constraint_key, array_to_string(list_sort(list(distinct query_id)), ',') as query_ids from ck group by 1")
def group_query_ids(spark, sf):
    found = lookups.group_ids(grouping.candidates(groups.stated(spark, sf)))
    return found.select("constraint_key", F.array_join(F.transform("query_ids", lambda x: x.cast("string")), ",").alias("query_ids"))


@query("group_users", f"{groups._W} select constraint_key, user_name, count(*) as runs from ck group by all")
def group_users(spark, sf):
    return lookups.group_users(grouping.candidates(groups.stated(spark, sf)))


@query("most_common_values", f"{with_('steps')}, c as (select query_id % 50 as g, step_name as value, count(*) as n, min(query_id) as first_seen from steps group by all) select *, row_number() over (partition by g order by n desc, first_seen, value) as place from c qualify row_number() over (partition by g order by n desc, first_seen, value) <= 3")
def most_common_values(spark, sf):
    s = relation(spark, sf, "steps").withColumn("g", F.col("query_id") % 50)
    return lookups.most_common(s, "g", F.col("step_name"), "query_id")


@query("catalog_cache", f"{with_('tables')} select table_id, case when table_id % 2 = 0 then 'cache' else 'live' end as origin from tables")
def catalog_cache(spark, sf):
    t = relation(spark, sf, "tables").select("table_id")
    found, _ = lookups.cache_first(t, t.where("table_id % 2 = 0").withColumn("origin", F.lit("cache")), t.withColumn("origin", F.lit("live")), "table_id")
    return found


# views in chains: each reads the next, every seventh an external table
_CHAINS = "v as (select 'db.s.view_' || cast(s_suppkey as varchar(20)) as view_key, case when s_suppkey % 7 = 0 then 'select a from spectrum_' || cast(s_suppkey % 4 as varchar(20)) || '.ext_' || cast(s_suppkey as varchar(20)) else 'select a from s.view_' || cast(s_suppkey + 1 as varchar(20)) || ' where a > 1' end as source_definition from {supplier})"
_ASKED = [f"view_{k}" if k % 2 else f"s.view_{k}" for k in range(1, 1000, 30)]


@query("catalog_closure", f"with recursive r as (select s_suppkey as k from supplier where s_suppkey % 30 = 1 and s_suppkey < 1000 union select k + 1 from r where k % 7 <> 0) select distinct 'spectrum_' || cast(k % 4 as varchar) || '.ext_' || cast(k as varchar) as table_key from r join supplier on s_suppkey = k where k % 7 = 0")
def catalog_closure(spark, sf):
    v = spark.sql(f"with {_CHAINS.replace('{supplier}', f'parquet.`{sf}/supplier.parquet`')} select * from v")
    t = external.catalog_keyed(relation(spark, sf, "externals")).select(F.col("external_table_key").alias("table_key"))
    return lookups.catalog_closure(_ASKED, t, v)[0]


_INS = f"{with_(*core.BASE)}, {core.SLOW}, {core.RISK}, {core.QOP}, {core.TOP}, {core.INSIGHTS}"
_LABEL = "case when contains(rule_id, 'SPILL') then 'blocks' when contains(rule_id, 'RATIO') or contains(rule_id, 'SHARE') then 'share' when contains(rule_id, 'SKEW') then 'skew' when contains(rule_id, 'ROWS') or contains(rule_id, 'WASTE') then 'rows' when contains(rule_id, 'COST') then 'score' else 'count' end"
_BAND = "case when impact_score >= 90 then 'severe' when impact_score >= 75 then 'high' when impact_score >= 50 then 'medium' else 'low' end"


@query("insight_decoration", f"{_INS} select upper(left(scope, 1)) || substr(scope, 2) as target_type, rule_id, {_LABEL} as metric_label, {_BAND} as impact_band, count(*) as n from ins group by all")
def insight_decoration(spark, sf):
    found = rules.decorated(rules.insights(core.slow(spark, sf), core.risk(spark, sf)))
    return found.groupBy("target_type", "rule_id", "metric_label", "impact_band").agg(F.count("*").alias("n"))


@query("capped_insights", f"{_INS} select scope, subject, rule_id, {near_sql('impact_score')} as impact_score, (select count(*) from ins) > 1000 as truncated from ins order by 4 desc, subject, rule_id limit 1000")
def capped_insights(spark, sf):
    found = rounded(rules.insights(core.slow(spark, sf), core.risk(spark, sf)), "impact_score").select("scope", "subject", "rule_id", "impact_score")
    return rules.capped(found, 1000, F.desc("impact_score"), F.asc("subject"), F.asc("rule_id"))


@query("cluster_severity", f"{with_('history')}, c as (select namespace_id, namespace_id <> 'ns4' as enabled, 3000 as expected, count(*) filter (query_id % (cast(right(namespace_id, 1) as integer) + 1) = 0) as loaded from history group by 1) select namespace_id, case when not enabled then 'disabled' when loaded >= expected then 'complete' when loaded * 2 < expected then 'red' else 'amber' end as severity from c")
def cluster_severity(spark, sf):
    h = relation(spark, sf, "history").withColumn("k", F.expr("cast(right(namespace_id, 1) as int) + 1"))
    c = h.groupBy("namespace_id").agg(F.count(F.when(F.col("query_id") % F.col("k") == 0, 1)).alias("loaded")).withColumn("enabled", F.col("namespace_id") != "ns4").withColumn("expected", F.lit(3000))
    return storage.cluster_severity(c).select("namespace_id", "severity")
