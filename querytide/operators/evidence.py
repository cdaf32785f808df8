"""What the plan and the execution say of each join of a statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import zero

# Words that tell a plan node of a join, words of a condition that name nothing, prefixes of a node's condition, and the movements a node can name.
JOIN_NODE = r"(?i)\b(?:join|nestloop|nested loop)\b"
TOKEN = r"[a-z_][a-z0-9_$]*"
IGNORED = ("on", "and", "or", "cast", "varchar", "char", "as", "true", "false")
CONDITION_PREFIX = r"^\s*(?:hash\s+cond|merge\s+cond|join\s+filter|filter)\s*:\s*"
MOVEMENTS = ("DS_DIST_BOTH", "DS_BCAST_INNER", "DS_DIST_INNER", "DS_DIST_OUTER")
NO_PLAN, NO_JOIN_NODE, UNRESOLVED = "No SYS_QUERY_EXPLAIN rows loaded", "No join plan nodes found", "Plan join present; SQL-to-plan match unresolved"
NO_MOVEMENT = "No mapped movement signal"

_WANTED = ["condition", "column_pairs", "physical_column_pairs", "left_physical_sources", "right_physical_sources"]
_SUMS = {"actual_duration_s": "duration_s", "actual_input_rows": "input_rows", "actual_output_rows": "output_rows", "actual_input_bytes": "input_bytes", "actual_output_bytes": "output_bytes", "actual_local_spill_blocks": "spilled_block_local_disk", "actual_remote_spill_blocks": "spilled_block_remote_disk", "actual_remote_read_blocks": "remote_read_io"}
_MOST = {"actual_max_data_skew": "data_skewness", "actual_max_time_skew": "time_skewness"}


def condition(text: Column) -> Column:
    """A condition without its prefix and outer brackets, in lower case and with single blanks."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), CONDITION_PREFIX, "")
    return F.regexp_replace(F.btrim(bare, F.lit("() ")), r"\s+", " ")


def wanted(joins: DataFrame) -> DataFrame:
    """joins with what to look for in a node: tokens, condition, and the tables of its physical columns."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) if c in joins.columns else F.lit("")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *[has(c) for c in _WANTED])), F.lit(f"({TOKEN})"), 1))
    sources = F.concat(*[F.split(F.lower(has(c)), ",") for c in _WANTED[3:]])
    tables = F.filter(F.transform(sources, lambda s: F.get(F.reverse(F.split(F.trim(s), r"\.")), 1)), lambda t: t.isNotNull())
    return joins.withColumns({"_tokens": F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*IGNORED)), "_condition": condition(has("condition")), "_tables": tables})


def nodes_of(explain: DataFrame) -> DataFrame:
    """(query_id, _nodes): a query's join nodes, or all its nodes if none is one, in the order of their sequence and id."""
    get = lambda c: F.col(c) if c in explain.columns else F.lit(None)
    text = F.concat_ws(" ", F.coalesce("plan_node", F.lit("")), F.coalesce("plan_info", F.lit("")))
    order = lambda c: F.coalesce(get(c).try_cast("long"), F.lit((1 << 63) - 1))
    node = F.struct(
        order("child_query_sequence").alias("o1"), order("plan_node_id").alias("o2"), get("plan_node_id").try_cast("long").alias("id"), get("child_query_sequence").try_cast("long").alias("sequence"), get("plan_parent_id").try_cast("long").alias("parent"),
        F.coalesce("plan_node", F.lit("")).alias("node"), F.coalesce("plan_info", F.lit("")).alias("info"), F.lower(text).alias("text"), condition(text).alias("condition"), text.rlike(JOIN_NODE).alias("joins"),
    )
    per = explain.groupBy("query_id").agg(F.sort_array(F.collect_list(node)).alias("_all"))
    joins = F.filter("_all", lambda n: n["joins"])
    return per.select("query_id", F.when(F.size(joins) > 0, joins).otherwise(F.col("_all")).alias("_nodes"))


def details_of(details: DataFrame) -> DataFrame:
    """Measures of a node by (query_id, plan_node_id, sequence), and over all sequences where `every` is true."""
    get = lambda c: F.col(c).try_cast("double") if c in details.columns else F.lit(None).cast("double")
    place = F.struct(*[(F.col(c) if c in details.columns else F.lit(0)).alias(c) for c in ("stream_id", "segment_id", "step_id")], F.trim("step_name").alias("name"))
    names = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.trim("step_name") != "", place))), lambda x: x["name"]))
    rows = details.withColumns({"_node": F.col("plan_node_id").try_cast("long"), "_sequence": F.col("child_query_sequence").try_cast("long") if "child_query_sequence" in details.columns else F.lit(None).cast("long")}).where("_node is not null")
    # a candidate without a sequence takes all of its node's steps
    both = rows.withColumn("_every", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("_sequence", F.when(~F.col("_every"), F.col("_sequence")))
    return both.where("_every or _sequence is not null").groupBy("query_id", "_node", "_every", "_sequence").agg(F.array_join(names, ", ").alias("actual_step_names"), *[F.sum(F.coalesce(get(c), F.lit(0.0))).alias(k) for k, c in _SUMS.items()], *[F.max(get(c)).alias(k) for k, c in _MOST.items()])


def plan_evidence(joins: DataFrame, explain: DataFrame, details: DataFrame) -> DataFrame:
    """Each join (query_id, join_no, condition, column_pairs, …) with the plan node that fits it best, and what its steps measured.

    A node gains 1 for each token of the join in its text, 4 for its condition, 2 for each physical column whose table it
    names; of equal nodes the first by sequence and id is taken. A query's nodes are gathered once, and scored inside its
    joins' rows by array functions: no row for each pair of a join and a node. Steps meet by node and sequence."""
    j = wanted(joins)
    number = joins.groupBy("query_id").agg(F.count("*").alias("_joins"))
    both = j.join(number, "query_id").join(nodes_of(explain), "query_id", "left")

    def scored(n: Column) -> Column:
        tokens = F.aggregate("_tokens", F.lit(0), lambda a, t: a + F.when(n["text"].contains(t), 1).otherwise(0))
        tables = F.aggregate("_tables", F.lit(0), lambda a, t: a + F.when(n["text"].contains(t), 2).otherwise(0))
        fits = F.when((F.col("_condition") != "") & n["condition"].contains(F.col("_condition")), 4).otherwise(0)
        return F.struct((tokens + tables + fits).alias("score"), n.alias("node"))

    # the sort is stable, so of equal scores the first node stays first
    best = F.get(F.array_sort(F.transform("_nodes", scored), lambda a, b: b["score"] - a["score"]), 0)
    s, n = F.col("_best")["score"], F.col("_best")["node"]
    alone = (F.col("_joins") == 1) & (F.size("_nodes") == 1)
    confidence = F.when(s >= 4, "high").when(s >= 2, "medium").otherwise("single-join inference")
    status = F.when(F.col("_nodes").isNull(), NO_PLAN).when(F.size("_nodes") == 0, NO_JOIN_NODE).when((s <= 0) & ~alone, UNRESOLVED).otherwise(F.concat(F.lit("Matched ("), confidence, F.lit(")")))
    found = both.withColumn("_best", best).withColumn("plan_match_status", status)
    hit = F.col("plan_match_status").startswith("Matched")
    text = lambda c: F.coalesce(F.when(hit, F.trim(c)), F.lit(""))
    found = found.withColumns({
        "plan_match_confidence": F.when(hit, confidence).otherwise("none"), "plan_node_id": F.when(hit, n["id"]), "plan_parent_id": F.when(hit, n["parent"]), "plan_child_query_sequence": F.when(hit, n["sequence"]),
        "plan_operator": text(n["node"]), "plan_condition": text(n["info"]),
    }).drop("_tokens", "_condition", "_tables", "_joins", "_nodes", "_best")
    d = details_of(details).withColumnRenamed("query_id", "_query")
    same = (F.col("query_id") == F.col("_query")) & (F.col("plan_node_id") == F.col("_node")) & (F.col("plan_child_query_sequence").isNull() == F.col("_every")) & F.col("plan_child_query_sequence").eqNullSafe(F.col("_sequence"))
    out = found.join(d, same, "left").drop("_query", "_node", "_every", "_sequence")
    said = F.upper(F.concat_ws(" ", "plan_operator", "plan_condition", "actual_step_names"))
    named = F.array_compact(F.array(*[F.when(said.contains(m), m) for m in MOVEMENTS]))
    more = F.array_compact(F.array(F.when(said.contains("BROADCAST") & ~F.array_contains(named, "DS_BCAST_INNER"), "BROADCAST"), F.when(said.contains("DISTRIBUTE") & ~F.exists(named, lambda m: m.contains("DIST")), "DISTRIBUTE")))
    signals = F.array_join(F.concat(named, more), ", ")
    out = out.withColumn("actual_movement", F.when(~hit, "").when(signals != "", signals).otherwise(NO_MOVEMENT))
    return out.withColumns({"actual_step_names": F.coalesce("actual_step_names", F.lit("")), **{c: zero(c) for c in (*_SUMS, *_MOST)}})
