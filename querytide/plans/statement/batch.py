"""The single-statement tools over all distinct statements of a table: rewrites, staged decomposition and lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rewrites, stages, views
from .rewrites import Catalog
from .sharing import Shared

REWRITTEN = "sql_hash string, rules array<string>, blocked array<string>, sql string, error string"
STAGED = "sql_hash string, tables array<string>, distkeys array<string>, sortkeys array<string>, gain double, score double, script string, error string"
LINEAGE = "sql_hash string, output string, origins array<string>"


def _over(queries: DataFrame, schema: str, rows: Callable[[Shared, str, str], list[tuple]], tool: Callable[[str], object]) -> DataFrame:
    """Applies `rows` to each distinct text of `queries` (sql_text) once, on all cores; `tool` reads a form once for all its statements."""
    distinct = queries.where(F.col("sql_text").isNotNull()).select(F.sha2("sql_text", 256).alias("sql_hash"), "sql_text").dropDuplicates(["sql_hash"])
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = Shared(tool)
        for pdf in batches:
            yield pd.DataFrame([r for key, text in zip(pdf["sql_hash"], pdf["sql_text"], strict=True) for r in rows(shared, key, text)], columns=names)

    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct.repartition(n, "sql_hash").mapInPandas(run, schema)


def rewritten(queries: DataFrame, catalog: Catalog, bodies: dict[str, str] | None = None) -> DataFrame:
    """Each statement after the checked rewrites: the rules that applied, those that did not and why, the text."""

    read = lambda t: rewrites.optimized(t, catalog, bodies)

    def rows(tool: Shared, key: str, text: str) -> list[tuple]:
        r, put = (read(text), str) if bodies else tool(text)
        if r.error is not None and put is not str:
            r, put = read(text), str  # the message tells the place in the text
        return [(key, [n for n, _ in r.applied], [put(f"{n}: {why}") for n, why in r.blocked], put(r.sql) if r.applied else text, r.error)]

    return _over(queries, REWRITTEN, rows, read)


def staged(queries: DataFrame, catalog: Catalog, bodies: dict[str, str] | None = None, external: frozenset[str] = frozenset()) -> DataFrame:
    """Each statement's staging plan: staged tables with their keys, expected gain, decomposability and the script."""

    read = lambda t: stages.decomposed(t, catalog, bodies, external)

    def rows(tool: Shared, key: str, text: str) -> list[tuple]:
        p, put = (read(text), str) if bodies else tool(text)
        if p.error is not None and put is not str:
            p, put = read(text), str
        if put is not str:
            p = replace(p, stages=[replace(s, filters=sorted(map(put, s.filters))) for s in p.stages], final=put(p.final))
        made = p.stages
        return [(key, [s.table for s in made], [s.distkey or "" for s in made], [s.sortkey or "" for s in made], float(p.gain), float(p.score), p.script, p.error)]

    return _over(queries, STAGED, rows, read)


def lineages(queries: DataFrame, columns: dict[str, list[str]], bodies: dict[str, str] | None = None) -> DataFrame:
    """Output columns of each statement and the table columns that they come from; a statement that is not understood has no rows."""

    def read(text: str) -> list[tuple]:
        try:
            found = views.lineage(text, columns, bodies)
        except (SyntaxError, RecursionError):
            return []
        return [(name, sorted(f"{o.table}.{o.column}" for o in origins)) for name, origins in found.items()]

    def rows(tool: Shared, key: str, text: str) -> list[tuple]:
        return [(key, *r) for r in tool(text)[0]]

    return _over(queries, LINEAGE, rows, read)
