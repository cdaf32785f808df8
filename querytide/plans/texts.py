"""Queries of the statement tools over distinct statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grouping
from ..functions import shapes
from ..sources.adapter import relation, with_
from .statement import facts, similarity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def facts_of(spark, sf) -> DataFrame:
    return facts.analysed(relation(spark, sf, "statements"))


@query("statement_facts")
def statement_facts(spark, sf):
    return facts_of(spark, sf)


@query(
    "statement_fact_counts",
    f"""{with_("statements")}, d as (select sql_text, min(query_id) % 8 as k from statements group by 1) select k, case when k = 5 then 'regex' else 'ast' end as method, count(*) as statements,
 cast(sum(case when k = 3 then 1 else 0 end) as bigint) as joins, cast(sum(case when k = 0 then 1 else 0 end) as bigint) as wildcards, cast(sum(case k when 2 then 2 when 3 then 2 when 5 then 0 else 1 end) as bigint) as tables,
 cast(sum(case when k = 1 then 1 else 0 end) as bigint) as leading_wildcards from d group by all""",
)
def statement_fact_counts(spark, sf):
    """What the parser finds in the eight statement templates, against what the templates hold."""
    d = relation(spark, sf, "statements").groupBy("sql_text").agg((F.min("query_id") % 8).alias("k")).select(F.sha2("sql_text", 256).alias("sql_hash"), "k")
    found = facts_of(spark, sf).join(d, "sql_hash")
    n = lambda c: F.sum(c).cast("long")
    return found.groupBy("k", "method").agg(F.count("*").alias("statements"), n(F.col("join_count")).alias("joins"), n(F.col("wildcard_count")).alias("wildcards"), n(F.size("tables")).alias("tables"), n(F.array_contains("markers", "leading-wildcard-like").cast("int")).alias("leading_wildcards"))


@query("statement_fingerprints")
def statement_fingerprints(spark, sf):
    return facts_of(spark, sf).groupBy("fingerprint").agg(F.count("*").alias("statements"), F.min("shape").alias("shape"))


_PROC = "procs as (select o_orderkey as id, 'db.etl.p_' || cast(o_orderkey as varchar(20)) as procedure_key, 'begin insert into t select ''a;b''; update t set x = ' || cast(o_orderkey as varchar(20)) || '; -- c; d' || chr(10) || ' end;' as source_definition from {orders})"


@query("procedure_statements", f"with {_PROC.replace('{orders}', 'orders')} select procedure_key, 0 as statement_no, 'insert into t select ''a;b''' as sql_text from procs union all select procedure_key, 1, 'update t set x = ' || cast(id as varchar) from procs")
def procedure_statements(spark, sf):
    return facts.procedure_statements(spark.sql(f"with {_PROC.replace('{orders}', f'parquet.`{sf}/orders.parquet`')} select * from procs"))


def _captured(spark) -> DataFrame:
    return spark.createDataFrame([("DB1.etl.load_0",), ("db1.etl.load_1",), ("db1.etl.load_2",), ("db1.etl.load_3",)], "procedure_key string")


@query("call_resolution", f"{with_('statements')} select query_id, 'db1.etl.load_' || cast(query_id % 4 as varchar) as call_key from statements where query_id % 8 = 5")
def call_resolution(spark, sf):
    """Every CALL among all statements, its key read from the text."""
    from ..operators.grouping import resolved_calls

    s = relation(spark, sf, "statements").select("query_id", shapes.call_key("sql_text", F.lit("db1")).alias("call_key"))
    return resolved_calls(s.where(F.col("call_key").isNotNull()), _captured(spark))


_COMMENTED = "case query_id % 3 when 0 then '/* a */ -- b' || chr(10) || ' ' || sql_text when 1 then '  ' || sql_text else '-- only' end"


@query("leading_comments", rf"{with_('statements')} select query_id, regexp_replace({_COMMENTED}, '(?s)^(?:\s+|--[^\n]*(?:\n|$)|/\*.*?(?:\*/|$))+', '') as body from statements")
def leading_comments(spark, sf):
    s = relation(spark, sf, "statements").withColumn("text", F.expr(_COMMENTED))
    return s.select("query_id", shapes.without_leading_comments("text").alias("body"))


_PLAIN = [r"(?s)/\*.*?\*/", r"--[^\r\n]*"]
_NUMBER, _LIST = r"(^|[^a-z0-9_$])[-+]?\d+(?:\.\d+)?([^a-z0-9_$.]|$)", r"\(\s*\?(?:\s*,\s*\?)+\s*\)"


def _plain_sql() -> str:
    """The oracle's text shape; RE2 has no look-around, so numbers take their neighbours along, twice over."""
    sub = lambda c, p, n: f"regexp_replace({c}, '{p}', '{n}', 'g')"
    t = sub(sub("sql_text", _PLAIN[0], " "), _PLAIN[1], " ")
    t = "lower(" + sub(t, "''(?:[^'']|'''')*''", "?") + ")"
    return "trim(" + sub(sub(sub(sub(t, _NUMBER, r"\1?\2"), _NUMBER, r"\1?\2"), _LIST, "(?)"), r"\s+", " ") + ")"


@query("text_shapes", f"{with_('statements')} select query_id, {_plain_sql()} as shape from statements")
def text_shapes(spark, sf):
    return relation(spark, sf, "statements").select("query_id", shapes.text_shape("sql_text").alias("shape"))


@query("joined_users", f"{with_('history')}, u as (select query_id % 97 as g, trim(user_name) as v, min(query_id) as o from history where trim(user_name) <> '' group by all), r as (select *, row_number() over (partition by g order by o) as n from u) select g, coalesce(string_agg(v, ', ' order by o) filter (n <= 8), '') as users, coalesce(array_to_string(list_sort(list(v))[1:5], ', '), '') as sorted from r group by g")
def joined_users(spark, sf):
    h = relation(spark, sf, "history").withColumn("g", F.col("query_id") % 97)
    return grouping.first_users(h, ["g"], "user_name", "query_id").join(h.groupBy("g").agg(shapes.joined_sorted("user_name", 5).alias("sorted")), "g")


@query("similar_parsed")
def similar_parsed(spark, sf):
    """Parsed similarity to one statement; pytest holds the parts against their formulas."""
    return similarity.alike("select a, b from brand_1.part_x_1 where name like '%x'", relation(spark, sf, "statements"))
