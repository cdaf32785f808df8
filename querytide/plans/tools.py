"""Queries of the statement tools over one statement for each order, against what the templates hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .statement import batch
from .statement.rewrites import Meta

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# template -> text around the order's key
TEMPLATES = {
    0: ("select v from s.f where date(event_date) = '2024-01-31' and v > ", ""),
    1: ("select name from s.d d where d.k not in (select f.k from s.f f where f.v > ", ")"),
    2: ("select distinct k, count(*) as n from s.f where v > ", " group by k"),
    3: ("select f.v, d.name from s.f f join s.d d on f.k = d.k where f.k = ", ""),
    4: ("select f.v, d.name from s.f f join s.d d on f.k = d.k where f.event_date > '2024-01-01' and d.name = 'x", "'"),
    5: ("insert into t values (", ")"),
}
CATALOG = {"db.s.f": Meta(sortkeys=["event_date"], not_null={"k"}, columns=["k", "v", "event_date"], rows=5e9, size_mb=2e5), "db.s.d": Meta(sortkeys=[], not_null={"k"}, columns=["k", "name"], rows=100, size_mb=1)}
_TEXT = "case o_orderkey % 6 " + " ".join("when {} then '{}' || cast(o_orderkey as varchar(20)) || '{}'".format(k, *(x.replace("'", "''") for x in t)) for k, t in TEMPLATES.items()) + " end"


def made(spark, sf) -> DataFrame:
    return spark.sql(f"select o_orderkey % 6 as k, {_TEXT} as sql_text from parquet.`{sf}/orders.parquet`")


def by_template(spark, sf, found: DataFrame) -> DataFrame:
    keys = made(spark, sf).select(F.sha2("sql_text", 256).alias("sql_hash"), "k").dropDuplicates(["sql_hash"])
    return found.join(keys, "sql_hash")


def query(name: str, oracle: str):
    def register(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return register


_RULES = "case o_orderkey % 6 when 0 then 'SARGABLE_SORTKEY' when 1 then 'NOT_IN_TO_NOT_EXISTS' when 2 then 'REDUNDANT_DISTINCT' when 3 then 'PROPAGATE_JOIN_FILTER' else '' end"


@query("statement_rewrites", f"select o_orderkey % 6 as k, {_RULES} as rules, o_orderkey % 6 = 5 as failed, count(*) as statements from orders group by all")
def statement_rewrites(spark, sf):
    found = by_template(spark, sf, batch.rewritten(made(spark, sf), CATALOG))
    return found.groupBy("k", F.array_join("rules", ",").alias("rules"), F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("statements"))


_STAGES = {0: ("s.f", "", "event_date"), 1: ("s.f", "", "v"), 2: ("s.f", "", "v"), 3: ("s.f", "k", "k"), 4: ("s.f", "k", "event_date"), 5: ("", "", "")}
_PICK = lambda i: "case o_orderkey % 6 " + " ".join(f"when {k} then '{v[i]}'" for k, v in _STAGES.items()) + " end"


@query("statement_stages", f"select o_orderkey % 6 as k, {_PICK(0)} as tables, {_PICK(1)} as distkeys, {_PICK(2)} as sortkeys, count(*) as statements from orders group by all")
def statement_stages(spark, sf):
    found = by_template(spark, sf, batch.staged(made(spark, sf), CATALOG))
    return found.groupBy("k", *[F.array_join(c, ",").alias(c) for c in ("tables", "distkeys", "sortkeys")]).agg(F.count("*").alias("statements"))


_OUTPUTS = "(values (0, 'v', 'db.s.f.v'), (1, 'name', 'db.s.d.name'), (2, 'k', 'db.s.f.k'), (2, 'n', ''), (3, 'v', 'db.s.f.v'), (3, 'name', 'db.s.d.name'), (4, 'v', 'db.s.f.v'), (4, 'name', 'db.s.d.name')) o(k, output, origins)"


@query("statement_lineage", f"select k, output, origins, count(*) as statements from orders join {_OUTPUTS} on k = o_orderkey % 6 group by all")
def statement_lineage(spark, sf):
    columns = {k: m.columns for k, m in CATALOG.items()}
    found = by_template(spark, sf, batch.lineages(made(spark, sf), columns))
    return found.groupBy("k", "output", F.array_join("origins", ",").alias("origins")).agg(F.count("*").alias("statements"))
