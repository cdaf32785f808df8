"""Similarity of statements, 0 to 1: text, tree, tokens and what the statements read, join, filter and return."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import shapes
from ...operators.grouping import indel_ratio
from . import facts
from . import tree as T

# The weights of the parts, for two statements that parse and for others.
PARSED = {"text": 0.25, "tree": 0.22, "tokens": 0.10, "pairs": 0.05, "tables": 0.09, "columns": 0.07, "joins": 0.04, "predicate_ops": 0.03, "join_columns": 0.06, "filter_columns": 0.05, "projected_columns": 0.04}
UNPARSED = {"text": 0.55, "tokens": 0.30, "pairs": 0.15}
_SETS = ("tables", "columns", "joins", "predicate_ops", "join_columns", "filter_columns", "projected_columns")


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


@dataclass
class Prepared:
    """What is compared of a statement. tree: a letter for each kind of node, in the order of reading; empty if it does not parse."""

    text: str
    tokens: set
    pairs: set
    tree: str
    sets: dict[str, set]


def prepared(statement: str, shape: str) -> Prepared:
    """`shape` is the statement's regular-expression shape, which stands in where it does not parse."""
    try:
        tree = T.parse(statement)
        found = facts.features(statement)
        kinds = sorted(k for k in dir(T) if isinstance(getattr(T, k), type))
        letters = {k: chr(0x100 + i) for i, k in enumerate(kinds)}
        nodes = "".join(letters.get(type(n).__name__, "?") for n in tree.walk())
        text, sets = facts.literal_free(statement), {k: set(found[k]) for k in _SETS}
    except (SyntaxError, RecursionError):
        text, nodes, sets = shape, "", {}
    words = re.findall(shapes.TOKEN, shape)
    return Prepared(text, set(words), set(zip(words, words[1:], strict=False)), nodes, sets)


def similarity(a: Prepared, b: Prepared) -> float:
    if not a.text or not b.text:
        return 0.0
    if a.text == b.text:
        return 1.0
    part = {"text": indel_ratio(a.text, b.text), "tokens": jaccard(a.tokens, b.tokens), "pairs": jaccard(a.pairs, b.pairs)}
    weights = UNPARSED
    if a.tree and b.tree:
        part |= {"tree": indel_ratio(a.tree, b.tree)} | {k: jaccard(a.sets[k], b.sets[k]) for k in _SETS}
        weights = PARSED
    return round(sum(w * part[k] for k, w in weights.items()), 4)


def alike(statement: str, queries: DataFrame, least: float = 0.68, most: int = 40) -> DataFrame:
    """Queries like a statement, best first (query_id, similarity): each distinct shape is parsed and compared once."""
    shaped = queries.where(F.col("sql_text").isNotNull()).select("query_id", "sql_text", shapes.regex_shape("sql_text").alias("shape"))
    own = queries.sparkSession.range(1).select(shapes.regex_shape(F.lit(statement)).alias("s")).first()["s"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = prepared(statement, own)
        for pdf in batches:
            yield pd.DataFrame({"shape": pdf["shape"], "similarity": [similarity(mine, prepared(t, s)) for t, s in zip(pdf["sql_text"], pdf["shape"], strict=True)]})

    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = shaped.groupBy("shape").agg(F.min("sql_text").alias("sql_text")).repartition(n, "shape")
    near = distinct.mapInPandas(run, "shape string, similarity double").where(F.col("similarity") >= least)
    return shaped.join(near, "shape").select("query_id", "similarity").orderBy(F.desc("similarity"), "query_id").limit(most)
