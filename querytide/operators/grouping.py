"""Repeat patterns: pre-filters, shapes, candidates, groups, members, targets and column demand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import shapes
from ..functions.exprs import token, zero

LEAST_CHARS, LEAST_GROUP = 24, 2
FUZZY = 0.95
AFFIX = 64
#: Statements longer than this keep their regex shape.
MOST_CHARS = 8000


def _counted(queries: DataFrame) -> tuple[DataFrame, list[tuple[list[str], str, DataFrame]]]:
    """Queries with their keys, and by kind of repetition (keys, column, runs of each key). Blank texts, users and hashes do not count."""
    norm = shapes.text_key("sql_text")
    q = queries.withColumn("_norm", norm).withColumn("_head", F.substring("_norm", 1, AFFIX)).withColumn("_tail", F.right("_norm", F.lit(AFFIX))).withColumn("_user", F.lower(F.trim(F.coalesce("user_name", F.lit("")))))
    said = q.where("_norm <> ''")
    kinds = [(["_norm"], "text_runs", said), (["_user", "_head", "_tail"], "affix_runs", said.where("_user <> ''"))]
    if "query_hash" in queries.columns:
        kinds.append((["query_hash"], "hash_runs", said.where(token("query_hash").isNotNull())))
    return q, [(keys, name, rows.groupBy(*keys).agg(F.count("*").alias(name))) for keys, name, rows in kinds]


def _flagged(queries: DataFrame, min_runs: int) -> tuple[DataFrame, Column, DataFrame]:
    """Queries with their runs, which of them repeat, and one row, `some`: whether any does.

    Counts are aggregated and joined back, so a hot key is combined before the shuffle. `some` is read off the counts, whose exchanges the joins use again."""
    q, kinds = _counted(queries)
    often, some = F.lit(False), None
    for keys, name, runs in kinds:
        q = q.join(runs, keys, "left").withColumn(name, zero(name))
        often = often | (F.col(name) >= min_runs)
        most = runs.agg(F.max(name).alias("most"))
        some = most if some is None else some.unionByName(most)
    # a blank text has no runs of its own, and those of its hash are none of its business
    return q, often & (F.col("_norm") != ""), some.agg((F.coalesce(F.max("most"), F.lit(0)) >= min_runs).alias("some"))


_KEYS = ["_norm", "_head", "_tail", "_user"]


def repeating(queries: DataFrame, min_runs: int = 3) -> DataFrame:
    """Queries that repeat: same normalised text, or same user with the same opening and closing characters, or the same
    query hash where there is a column query_hash (blank ones do not count)."""
    q, often, _ = _flagged(queries, min_runs)
    return q.where(often).drop(*_KEYS)


def repeating_or_all(queries: DataFrame, min_runs: int = 3) -> DataFrame:
    """Queries that repeat, or all of them where none does, so that an analysis is never blank; `prefiltered` says which.

    The branch is in the plan: a scalar subquery over the counts, without an action and without a further scan."""
    q, often, some = _flagged(queries, min_runs)
    return q.withColumn("prefiltered", some.scalar()).where(often | ~F.col("prefiltered")).drop(*_KEYS)


def candidates(queries: DataFrame, by_user: bool = False) -> DataFrame:
    """Shape, scope and constraint key of each statement; statements under LEAST_CHARS characters stay out.

    Expects query_id, sql_text, query_type, database_name, user_name, elapsed_s, risk_score."""
    # what several columns need stands in a column of its own, so that no expression is worked out twice
    q = queries.withColumn("_bare", shapes.without_leading_comments("sql_text"))
    q = q.withColumn("_unload", F.lower(F.substring("_bare", 1, 6)) == "unload").withColumn("_called", shapes.called("_bare"))
    body = F.when(F.col("_unload"), shapes.unloaded("_bare", bare=True)).otherwise(F.col("_bare"))
    scope = F.lower(F.coalesce(token("user_name"), F.lit("unknown"))) if by_user else F.lit("all")
    shape = shapes.values_tail(shapes.regex_shape(body))
    prefix = F.when(F.col("_unload"), "unload: ").otherwise("")
    q = q.withColumn("call_key", shapes.key_of_called("_called", "database_name")).withColumn("shape", F.concat(prefix, shape)).withColumn("scope", scope).drop("_bare", "_unload", "_called")
    kind = F.when(F.col("call_key").isNotNull(), "proc").otherwise("sql")
    body_key = F.when(F.col("call_key").isNotNull(), F.col("call_key")).otherwise(F.substring(F.sha1("shape"), 1, 20))
    chars = F.length(F.trim("sql_text"))
    q = q.where((chars >= LEAST_CHARS) | ((chars >= 1) & F.col("call_key").isNotNull()))
    return q.withColumn("kind", kind).withColumn("constraint_key", F.concat_ws("|", kind, "scope", F.lower(F.coalesce("query_type", F.lit(""))), body_key))


def resolved_calls(calls: DataFrame, procedures: DataFrame) -> DataFrame:
    """Open call keys (db..proc) take the one captured db.schema.proc, where it is the only one."""
    parts = F.split("procedure_key", r"\.")
    unique = procedures.select(F.lower("procedure_key").alias("procedure_key")).distinct().withColumn("open_key", F.concat(parts[0], F.lit(".."), parts[2])).groupBy("open_key").agg(F.count("*").alias("n"), F.first("procedure_key").alias("resolved")).where("n = 1").drop("n")
    return calls.join(unique, calls["call_key"] == unique["open_key"], "left").withColumn("call_key", F.coalesce("resolved", "call_key")).drop("open_key", "resolved")


def groups(found: DataFrame, min_size: int = LEAST_GROUP) -> DataFrame:
    """One row per repeat group with totals, representative, tables, identifiers and display rank.

    The representative is the first member by (risk, elapsed, query_id); its statement comes along as min_by."""
    order = F.struct(-zero("risk_score").alias("r"), -zero("elapsed_s").alias("e"), F.col("query_id").alias("q"))
    out = found.groupBy("constraint_key").agg(
        F.count("*").alias("query_count"),
        F.sum(zero("elapsed_s")).alias("total_runtime_s"),
        F.avg(zero("elapsed_s")).alias("avg_runtime_s"),
        F.max("elapsed_s").alias("max_runtime_s"),
        F.max("risk_score").alias("max_risk"),
        F.avg("risk_score").alias("avg_risk"),
        F.min_by("query_id", order).alias("representative_id"),
        F.min_by("shape", order).alias("shape"),
        F.min_by("kind", order).alias("repeat_kind"),
        F.min_by("query_type", order).alias("query_type"),
        F.min("query_id").alias("first_id"),
        F.max("query_id").alias("last_id"),
        F.size(F.collect_set("user_name")).cast("long").alias("user_count"),
    )
    out = out.where(F.col("query_count") >= max(2, min_size))
    return out.withColumn("sql_tables", F.array_join(F.array_sort(shapes.tables("shape")), ", ")).withColumn("repeat_group_key", shapes.digest(F.concat_ws("|", "repeat_kind", "constraint_key", "shape")))


def placed(rows: DataFrame, score: str, order: list[Column], name: str) -> DataFrame:
    """rows with their place by `order`, which begins with `score` descending.

    Rows fall into classes of the score; a class's first place follows from the sizes of the higher classes, so no window
    holds more than one class."""
    classed = rows.withColumn("_class", F.floor(1000 * F.log1p(F.greatest(zero(score).cast("double"), F.lit(0.0)))))
    higher = W.orderBy(F.desc("_class")).rowsBetween(W.unboundedPreceding, -1)  # a row for each class: some ten thousands
    first = classed.groupBy("_class").agg(F.count("*").alias("_n")).select("_class", F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("_class").orderBy(*order))
    return classed.join(first, "_class").withColumn(name, place.cast("long")).drop("_class", "_before")


def display_ranked(grouped: DataFrame) -> DataFrame:
    """RQ001… by (total runtime, risk, size) over all groups."""
    order = [F.desc("total_runtime_s"), F.desc("max_risk"), F.desc("query_count"), F.asc("repeat_group_key")]
    rank = F.col("group_rank").cast("string")
    return placed(grouped, "total_runtime_s", order, "group_rank").withColumn("repeat_group_id", F.concat(F.lit("RQ"), F.lpad(rank, F.greatest(F.lit(3), F.length(rank)), F.lit("0"))))


def first_users(rows: DataFrame, keys: list[str], user: str, order: str, limit: int = 8) -> DataFrame:
    """(keys, users): the first `limit` different users of each group (whatever their case), as first written and in the order seen; '' without any.

    Users are made distinct before they are gathered, and only the first of each group travel on."""
    shown = shapes.collapsed(F.coalesce(F.col(user).cast("string"), F.lit("")))
    named = rows.select(*keys, shown.alias("_shown"), F.col(order).alias("_o"))
    different = named.where("_shown <> ''").groupBy(*keys, F.lower("_shown").alias("_low")).agg(F.min(F.struct("_o", "_shown")).alias("_first"))
    early = different.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_first"))).where(F.col("_n") <= limit)
    lists = early.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_first"))), lambda x: x["_first"]["_shown"]), ", ").alias("users"))
    every = rows.select(*keys).distinct()
    for k in keys:
        lists = lists.withColumnRenamed(k, f"_{k}")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return every.join(lists, same, "left").select(*keys, F.coalesce("users", F.lit("")).alias("users"))


def report(found: DataFrame, sums: list[str] = (), means: list[str] = (), merged: DataFrame | None = None, least: int = LEAST_GROUP) -> DataFrame:
    """The whole report of repeat groups: near-equal shapes merged (rows of fuzzy_merged), sizes judged after the merge.

    Totals and means of the given columns; the least, largest and mean similarity of the members' shapes to their group;
    the union and the intersection of the shapes' tables, predicate operators and joins; the first seen member as
    representative; all ids; and a durable key, with a number where two groups would share it. Shapes are analysed once
    for each constraint key, never for each statement."""
    if merged is not None:
        found = found.join(merged.select("constraint_key", "merged_key", "similarity"), "constraint_key", "left")
    else:
        found = found.withColumns({"merged_key": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double")})
    found = found.withColumn("group_key", F.coalesce("merged_key", "constraint_key")).withColumn("similarity", F.coalesce("similarity", F.lit(1.0)))
    # Numbers are summed under the texts as keys, which a hash aggregate can hold; lists of ids, texts by order and the like would sort all the wide
    # rows. What is left is a row for each different shape. Ids and users are gathered from narrow rows of their own.
    plain = found.agg(*[F.sum(zero(c)).alias(f"total_{c}") for c in sums], *[F.avg(c).alias(f"avg_{c}") for c in means], F.count("*")).schema
    added = lambda c: c if isinstance(found.schema[c].dataType, T.DecimalType) else F.col(c).cast("double")
    per = found.groupBy("group_key", "constraint_key", "similarity", "kind", "shape").agg(
        F.count("*").alias("query_count"),
        *[F.sum(zero(c)).alias(f"total_{c}") for c in sums],
        *[x for c in means for x in (F.sum(added(c)).alias(f"_sum_{c}"), F.count(c).alias(f"_count_{c}"))],
        F.sum("similarity").alias("_similarity"),
        F.min("query_id").alias("representative_id"),
    )
    numbers = ["query_count", *[f"total_{c}" for c in sums], *[f"_{x}_{c}" for c in means for x in ("sum", "count")], "_similarity"]
    seen = F.col("representative_id")
    per = per.groupBy("group_key", "constraint_key", "similarity").agg(*[F.sum(c).alias(c) for c in numbers], F.min_by(F.struct("shape", "kind"), seen).alias("_first"), F.min("shape").alias("shape"), F.min(seen).alias("representative_id"))
    sets = {"tables": shapes.tables("shape"), "predicate_ops": shapes.predicate_operators("shape")}
    per = per.select("*", *[v.alias(f"_{k}") for k, v in sets.items()])
    lists = {k: F.collect_list(f"_{k}") for k in sets}
    both = [F.array_join(F.array_sort(F.array_distinct(F.flatten(v))), ", ").alias(f"all_{k}") for k, v in lists.items()] + [F.array_join(F.array_sort(F.aggregate(v, F.element_at(v, 1), lambda a, x: F.array_intersect(a, x))), ", ").alias(f"common_{k}") for k, v in lists.items()]
    out = per.groupBy("group_key").agg(
        F.count("*").alias("shape_count"),
        *[F.sum(c).alias(c) for c in numbers],
        F.min("similarity").alias("min_similarity"),
        F.max("similarity").alias("max_similarity"),
        F.min_by("_first", seen).alias("_first"),
        F.min(seen).alias("representative_id"),
        *both,
    )
    of = lambda total, n: F.when(F.col(n) > 0, F.col(total) / F.col(n))
    out = out.where(F.col("query_count") >= max(2, least)).select(
        "group_key", "query_count",
        *[F.col(f"total_{c}").cast(plain[f"total_{c}"].dataType).alias(f"total_{c}") for c in sums],
        *[of(f"_sum_{c}", f"_count_{c}").cast(plain[f"avg_{c}"].dataType).alias(f"avg_{c}") for c in means],
        "min_similarity", "max_similarity", of("_similarity", "query_count").alias("avg_similarity"), "representative_id", "_first.shape", F.col("_first.kind").alias("repeat_kind"),
        "shape_count", *[f"{x}_{k}" for x in ("all", "common") for k in sets],
    )
    who = found.groupBy("group_key").agg(F.size(F.collect_set("user_name")).cast("long").alias("user_count"), F.array_sort(F.collect_set("query_id")).alias("query_ids"))
    order = ["group_key", "query_count", *[f"total_{c}" for c in sums], *[f"avg_{c}" for c in means], "min_similarity", "max_similarity", "avg_similarity", "representative_id", "shape", "repeat_kind", "user_count", "query_ids", "shape_count", *[f"{x}_{k}" for x in ("all", "common") for k in sets]]
    out = out.join(who, "group_key").select(*order).withColumn("_key", shapes.digest(F.concat_ws("|", "repeat_kind", "group_key", "shape")))
    again = F.row_number().over(W.partitionBy("_key").orderBy("group_key"))
    return out.withColumn("_n", again).withColumn("repeat_group_key", F.when(F.col("_n") > 1, F.concat("_key", F.lit("-"), F.col("_n").cast("string"))).otherwise(F.col("_key"))).drop("_key", "_n")


def members(found: DataFrame, grouped: DataFrame, shown: int = 10) -> DataFrame:
    """Members with their rank in the group; the first `shown` are marked."""
    order = W.partitionBy("constraint_key").orderBy(F.desc(zero("elapsed_s")), F.desc(zero("risk_score")), "query_id")
    joined = found.join(grouped.select("constraint_key", "repeat_group_key"), "constraint_key")
    return joined.withColumn("member_rank", F.row_number().over(order).cast("long")).withColumn("shown_in_tree", F.col("member_rank") <= shown)


def parent_targets(queries: DataFrame, most: int = 500) -> DataFrame:
    """Heaviest execution of each simple fingerprint, by total time."""
    fp = shapes.simple_shape("sql_text")
    found = queries.where(F.col("sql_text").isNotNull()).groupBy(F.md5(fp).alias("fingerprint")).agg(F.sum(zero("elapsed_s")).alias("total_s"), F.count("*").alias("runs"), F.max_by("query_id", F.struct(zero("elapsed_s").alias("e"), (-F.col("query_id")).alias("q"))).alias("target_id"))
    return found.orderBy(F.desc("total_s"), "fingerprint").limit(most)


def evidence_targets(history: DataFrame, steps: DataFrame, texts: DataFrame) -> DataFrame:
    """Representatives for evidence: successful, not from the cache, no procedures or utilities, with steps;
    one per database and text, the heaviest."""
    fit = history.where((F.lower("status") == "success") & ~F.col("result_cache_hit") & ~F.upper("query_type").isin("PROCEDURE", "UTILITY"))
    seen = fit.join(steps.select("query_id").distinct(), "query_id", "left_semi").join(texts.select("query_id", F.md5("sql_text").alias("text_md5")), "query_id")
    best = W.partitionBy("database_name", "text_md5").orderBy(F.desc_nulls_last("execution_time"), F.desc_nulls_last("elapsed_time"), "query_id")
    return seen.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def repeated_ids(queries: DataFrame, width: int = 80) -> DataFrame:
    """Heaviest id of each (owner, fingerprint) among statements whose owner and opening characters repeat."""
    q = queries.withColumn("owner", F.lower(F.coalesce(token("user_name"), F.lit("")))).withColumn("head", F.substring(shapes.text_key("sql_text"), 1, width)).where("head <> ''")
    often = q.groupBy("owner", "head").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    kept = q.join(often, ["owner", "head"], "left_semi")
    return kept.groupBy("owner", F.md5(shapes.simple_shape("sql_text")).alias("fingerprint")).agg(F.count("*").alias("runs"), F.max_by("query_id", F.struct(zero("elapsed_s").alias("e"), (-F.col("query_id")).alias("q"))).alias("query_id"))


def diagnostics(found: DataFrame) -> DataFrame:
    """Buckets, pairs and the largest bucket by kind, without making a pair."""
    per = found.groupBy("kind", "constraint_key").agg(F.count("*").alias("n"))
    return per.groupBy("kind").agg(F.count("*").alias("buckets"), F.sum("n").alias("statements"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("repeat_buckets"), F.sum(F.expr("n * (n - 1) div 2")).cast("long").alias("pairs"), F.max("n").alias("largest"))


def missed(found: DataFrame, grouped: DataFrame, most: int = 40) -> DataFrame:
    """Ungrouped statements that share type and table set but not shape."""
    rest = found.join(grouped, "constraint_key", "left_anti").withColumn("table_set", F.array_join(F.array_sort(shapes.tables("shape")), ",")).where("table_set <> ''")
    out = rest.groupBy("query_type", "table_set").agg(F.count("*").alias("statements"), F.size(F.collect_set("shape")).cast("long").alias("distinct_shapes"), F.sum(zero("elapsed_s")).alias("runtime_s"))
    return out.where("statements >= 2 and distinct_shapes >= 2").orderBy(F.desc("runtime_s"), "query_type", "table_set").limit(most)


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / (len a + len b), by bit-parallel longest common subsequence."""
    if not a and not b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    full, state = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        u = state & places.get(c, 0)
        state = ((state + u) | (state - u)) & full
    return 2.0 * (len(a) - state.bit_count()) / (len(a) + len(b))


#: No longer shape can reach FUZZY with a shorter one beyond this factor of its length.
_REACH = 2 / FUZZY - 1 + 1e-9
#: What near-equal shapes can differ in at most by their lengths: counted characters, which runs are split by.
_COUNTED = ["width", "commas", "marks", "letters_e"]


def _histogram(text: str) -> np.ndarray:
    """How often each character stands in a text, by 128 bins; texts differ by as many insertions at least as their bins do in sum."""
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) % 128, minlength=128).astype(np.int32)


class _Clusters:
    """Greedy complete-link clusters of shapes that come shortest first; one that nothing can join any more is closed."""

    def __init__(self) -> None:
        self.open: list[dict] = []

    def add(self, shape: str, key: str) -> Iterator[tuple]:
        reached, before = [], self.open
        for c in before:
            if len(shape) <= len(c["shapes"][0]) * _REACH:
                reached.append(c)
            else:
                yield from self._closed(c)
        self.open = reached
        counts = _histogram(shape)
        if self.open:
            heads = np.array([c["counts"] for c in self.open])
            room = (1 - FUZZY) * (heads.sum(axis=1) + len(shape)) + 1e-6
            for k in np.flatnonzero(np.abs(heads - counts).sum(axis=1) <= room).tolist():
                c = self.open[k]
                low = c["low"]
                for held in c["shapes"]:
                    low = min(low, indel_ratio(shape, held))
                    if low < FUZZY:
                        break
                else:
                    c["shapes"].append(shape)
                    c["keys"].append(key)
                    c["low"] = low
                    return
        self.open.append({"shapes": [shape], "keys": [key], "low": 1.0, "counts": counts})

    @staticmethod
    def _closed(c: dict) -> Iterator[tuple]:
        for key in c["keys"]:
            yield key, c["keys"][0], c["low"]

    def close(self) -> Iterator[tuple]:
        for c in self.open:
            yield from self._closed(c)
        self.open = []


def _clustered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Clusters of the runs of one partition, which come one after another, each shortest first."""
    now, clusters, names = None, _Clusters(), ["constraint_key", "merged_key", "similarity"]
    for batch in batches:
        found = []
        for run, shape, key in zip(batch["run"], batch["shape"], batch["constraint_key"], strict=True):
            if run != now:
                found += clusters.close()
                now = run
            found += clusters.add(shape, key)
        yield pd.DataFrame(found, columns=names)
    yield pd.DataFrame(list(clusters.close()), columns=names)


def _split_runs(rows: DataFrame, by: str) -> DataFrame:
    """Splits runs where no near-equal shapes can stand on both sides: between values of `by` that differ by more than the lengths allow.

    Only the distinct values of a run are ordered, and a text's length bounds them."""
    values = rows.groupBy("run", by).agg(F.max("width").alias("widest"))
    before = F.lag(by).over(W.partitionBy("run").orderBy(by))
    widest = F.max("widest").over(W.partitionBy("run"))
    gap = F.when(F.col(by) - before > 2 * (1 - FUZZY) * widest + 1, 1).otherwise(0)
    part = F.sum("gap").over(W.partitionBy("run").orderBy(by).rowsBetween(W.unboundedPreceding, 0))
    parts = values.withColumn("gap", gap).withColumn("part", part).select("run", by, "part")
    return rows.join(parts, ["run", by]).withColumn("run", F.md5(F.concat_ws("|", "run", "part"))).drop("part")


def fuzzy_merged(found: DataFrame) -> DataFrame:
    """constraint_key -> merged_key, similarity: near-equal shapes of one scope, type and table set.

    Works on distinct shapes, never on statements, so a hot statement costs one row. A block (scope, type, table set) is split
    into runs between which no pair can be near enough, by its lengths and by counts of single characters; runs are spread
    over the tasks. A task reads a run in order of length and holds only the shapes that are at most 10.6 % shorter than
    the present one, so its memory follows that band, not the block; within it, counts of all characters decide first."""
    distinct = found.where("kind = 'sql'").groupBy("constraint_key").agg(F.min("shape").alias("shape"), F.min("scope").alias("scope"), F.min(F.lower(F.coalesce("query_type", F.lit("")))).alias("type"))
    blocks = distinct.withColumn("table_set", F.array_join(F.array_sort(shapes.tables("shape")), ",")).where("table_set <> ''")
    count = lambda c: F.length("shape") - F.length(F.replace("shape", F.lit(c)))
    runs = blocks.select("constraint_key", "shape", F.md5(F.concat_ws("\n", "scope", "type", "table_set")).alias("run"), F.length("shape").alias("width"), count(",").alias("commas"), count("?").alias("marks"), count("e").alias("letters_e"))
    for by in _COUNTED:
        runs = _split_runs(runs, by)
    ordered = runs.repartition("run").sortWithinPartitions("run", "width", "shape", "constraint_key").select("run", "shape", "constraint_key")
    return ordered.mapInPandas(_clustered, "constraint_key string, merged_key string, similarity double")


def _bigrams(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n > 1, F.zip_with(F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def _token_share() -> Column:
    """What tokens (0.30) and neighbouring pairs (0.15) of left_shape and right_shape bring to their similarity."""
    x, y = shapes.tokens("left_shape"), shapes.tokens("right_shape")
    return 0.30 * shapes.jaccard(x, y) + 0.15 * shapes.jaccard(_bigrams(x), _bigrams(y))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


def pair_similarity(pairs: DataFrame) -> DataFrame:
    """Similarity of unparsed statements: 0.55 text, 0.30 tokens, 0.15 neighbouring pairs. Expects left_shape, right_shape."""
    return pairs.withColumn("similarity", 0.55 * _ratio("left_shape", "right_shape") + _token_share())


def similar_to(statement: str, queries: DataFrame, least: float = 0.68, most: int = 40) -> DataFrame:
    """Queries like a statement, best first. Each distinct shape is compared once, with its first `most` queries, of which no more
    can be wanted. The text's share of a score is 0.55 at most, so what the tokens and pairs do not bring to the rest is
    dropped before the texts are compared."""
    first = F.row_number().over(W.partitionBy("_shape").orderBy("query_id"))
    few = queries.withColumn("_shape", shapes.regex_shape("sql_text")).withColumn("_n", first).where(F.col("_n") <= most)
    # a condition on the key itself would be pushed down to each query, with the making of its shape at each mention
    shaped = few.groupBy("_shape").agg(F.collect_list(F.struct(*queries.columns)).alias("_rows"), F.min("_shape").alias("right_shape")).withColumn("left_shape", shapes.regex_shape(F.lit(statement)))
    near = pair_similarity(shaped.where(_token_share() >= least - 0.55 - 1e-9)).where(F.col("similarity") >= least)
    rows = near.select(F.explode("_rows").alias("_row"), "right_shape", "left_shape", "similarity").select("_row.*", "right_shape", "left_shape", "similarity")
    return rows.orderBy(F.desc("similarity"), "query_id").limit(most)


def features(queries: DataFrame) -> DataFrame:
    """Feature columns of each distinct statement by regular expressions: tables, operators, counts and the structure key."""
    shape = F.col("shape")
    out = queries.withColumn("shape", shapes.regex_shape(shapes.unloaded("sql_text")))
    n = lambda pattern: F.regexp_count(shape, F.lit(pattern)).cast("long")
    tables, ops = shapes.tables("shape"), shapes.predicate_operators("shape")
    out = out.withColumns({"sql_tables": F.array_join(F.array_sort(tables), ", "), "table_count": F.size(tables).cast("long"), "predicate_ops": F.array_join(F.array_sort(ops), ","), "join_count": n(r"\bjoin\b"), "predicate_count": n(r"\b(?:where|and|or|on|having)\b"), "subquery_count": n(r"\(\s*select\b"), "has_wildcard": shape.rlike(r"select\s+(?:distinct\s+)?\*")})
    return out.withColumn("structure_key", F.concat(F.lit("tables="), "sql_tables", F.lit(";predicate_count="), F.col("predicate_count").cast("string"), F.lit(";predicate_ops="), "predicate_ops"))


def incremental_features(queries: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features of all statements, features not in the cache yet): each distinct statement is analysed once.

    The cache is keyed by the statement's SHA-256."""
    keyed = queries.where(F.col("sql_text").isNotNull()).withColumn("sql_hash", F.sha2("sql_text", 256))
    fresh = features(keyed.select("sql_hash", "sql_text").dropDuplicates(["sql_hash"]).join(cache.select("sql_hash"), "sql_hash", "left_anti")).drop("sql_text")
    known = cache.unionByName(fresh)
    return keyed.join(known, "sql_hash"), fresh


def column_demand(patterns: DataFrame) -> DataFrame:
    """Weighted demand per table and column: filters count 1.0, joins 0.4, times runtime hours and runs.

    Expects repeat_group_id, sql_tables, sql_filter_columns, sql_join_columns (lists), total_runtime_s, query_count."""
    from ..functions.exprs import bare_column, split_names

    weight = F.greatest(F.lit(1.0), F.col("total_runtime_s") / 3600) * F.greatest(F.lit(1), F.col("query_count"))
    base = patterns.withColumn("weight", weight).withColumn("table_name", F.explode(split_names("sql_tables")))
    use = lambda c, kind, w: base.select("repeat_group_id", "table_name", F.explode(split_names(c)).alias("column"), F.lit(kind).alias("kind"), (F.col("weight") * w).alias("w"))
    both = use("sql_filter_columns", "filter", 1.0).unionByName(use("sql_join_columns", "join", 0.4))
    return both.groupBy(F.lower("table_name").alias("table_name"), bare_column("column").alias("column")).agg(F.sum("w").alias("demand"), F.size(F.collect_set("repeat_group_id")).cast("long").alias("pattern_count"), F.sum(F.when(F.col("kind") == "filter", F.col("w")).otherwise(0.0)).alias("filter_demand"))
