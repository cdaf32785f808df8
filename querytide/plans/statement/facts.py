"""Facts of parsed statements: shapes, features, slow markers, decomposability; and their batch form.

The batch form runs over distinct statements with mapInPandas; a statement that cannot be parsed or is
longer than MOST_CHARS keeps the regular-expression shape, which the caller has as a column. Length bears on
the shape only; a statement that cannot be parsed has its tables, counts and markers by regular expressions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from ...functions import shapes
from ...operators import grouping
from . import tree as T
from .sharing import Shared

MOST_CHARS = 8000


def _tree(sql: str | T.Node) -> T.Node:
    """Tools take a text or, where several read the same statement, its tree; none changes it."""
    return sql if isinstance(sql, T.Node) else T.parse(sql)


# Shapes ----------------------------------------------------------------------------------------
def _blank(n: T.Node) -> T.Node | None:
    if isinstance(n, T.Literal):
        return T.Literal("?")
    if isinstance(n, T.InList) and len(n.items) > 1 and all(isinstance(x, T.Literal) for x in n.items):
        return T.InList(n.value, [T.Literal("?")], n.negated)
    return None


def literal_free(sql: str | T.Node) -> str:
    """Every literal is ?, lists of literals have one; names, blanks and comments in one form."""
    return T.sql(T.mapped(_tree(sql), _blank))


def order_free(sql: str | T.Node) -> str:
    """As literal_free, with aliases by appearance, and conjuncts, outputs and group keys sorted."""
    tree = T.mapped(_tree(sql), _blank)
    names: dict[str, str] = {}
    for n in tree.walk():
        if isinstance(n, (T.Table, T.Derived)):
            for x in filter(None, (n.alias, n.parts[-1] if isinstance(n, T.Table) else None)):
                names.setdefault(x, names.get(n.alias or "", f"_t{len(names)}"))

    def one(n: T.Node) -> T.Node | None:
        if isinstance(n, T.Column) and n.qualifier in names:
            return T.Column([names[n.qualifier], n.name])
        if isinstance(n, (T.Table, T.Derived)):
            keep = names.get(n.alias or (n.parts[-1] if isinstance(n, T.Table) else ""), n.alias)
            return T.Table(n.parts, keep) if isinstance(n, T.Table) else T.Derived(n.query, keep)
        if isinstance(n, T.Binary) and n.op in ("and", "or"):
            flat: list[T.Node] = []

            def spread(x: T.Node) -> None:
                if isinstance(x, T.Binary) and x.op == n.op:
                    spread(x.left)
                    spread(x.right)
                else:
                    flat.append(x)

            spread(n)
            flat.sort(key=T.sql)
            out = flat[0]
            for x in flat[1:]:
                out = T.Binary(n.op, out, x)
            return out
        if isinstance(n, T.Binary) and n.op == "=" and T.sql(n.right) < T.sql(n.left):
            return T.Binary("=", n.right, n.left)
        if isinstance(n, T.Select):
            n.outputs = sorted((T.Output(o.value) for o in n.outputs), key=T.sql)
            n.group = sorted(n.group, key=T.sql)
        return None

    return T.sql(T.mapped(tree, one))


def fingerprint(sql: str) -> str:
    """Q and sixteen hex digits of the order-free shape; of the collapsed text if it does not parse."""
    try:
        body = order_free(sql)
    except (SyntaxError, RecursionError):
        body = re.sub(r"\s+", " ", re.sub(r"'(?:[^']|'')*'|\b\d+(?:\.\d+)?\b", "?", sql.lower())).strip()
    return _digest(body)


def _digest(body: str) -> str:
    return "Q" + hashlib.sha256(body.encode()).hexdigest()[:16]


# Features --------------------------------------------------------------------------------------
def features(sql: str | T.Node) -> dict:
    """Tables, columns by use, joins, predicates and counts of a statement."""
    tree = _tree(sql)
    nodes = list(tree.walk())
    selects = [n for n in nodes if isinstance(n, T.Select)]
    cols = lambda ns: list(dict.fromkeys(c.name for n in ns if n is not None for c in n.walk() if isinstance(c, T.Column)))
    joins = [j for s in selects for j in s.joins]
    predicates = [p for s in selects for x in (s.where, s.having, s.qualify) for p in T.conjuncts(x)]
    # an equality between two sources in WHERE joins them
    implicit = [p for p in predicates if isinstance(p, T.Binary) and p.op == "=" and isinstance(p.left, T.Column) and isinstance(p.right, T.Column) and p.left.qualifier != p.right.qualifier]
    filters = [p for p in predicates if p not in implicit]
    on = [j.on for j in joins]
    return {
        "tables": sorted({t.key for t in T.tables(tree)}),
        "ctes": sorted({c.name for c in nodes if isinstance(c, T.Cte)}),
        "columns": cols([tree]),
        "join_columns": list(dict.fromkeys(cols(on) + cols(implicit) + [u for j in joins for u in j.using])),
        "filter_columns": cols(filters),
        "projected_columns": cols([o for s in selects for o in s.outputs]),
        "group_columns": cols([g for s in selects for g in s.group]),
        "order_columns": cols([o for s in selects for o in s.order]),
        "joins": [f"{j.kind}:{T.sql(j.source) if isinstance(j.source, T.Table) else 'subquery'}" for j in joins],
        "predicate_ops": sorted({_operator(p) for p in filters}),
        "join_count": len(joins),
        "predicate_count": len(predicates),
        "wildcard_count": sum(isinstance(o.value, T.Star) for s in selects for o in s.outputs),
        "subquery_count": len(selects) - 1 if selects else 0,
        "has_union": any(isinstance(n, T.SetOp) for n in nodes),
    }


def _operator(p: T.Node) -> str:
    match p:
        case T.Binary(op):
            return op
        case T.Between():
            return "between"
        case T.InList() | T.InQuery():
            return "in"
        case T.IsNull():
            return "is"
        case T.Exists():
            return "exists"
    return "other"


# Slow markers ----------------------------------------------------------------------------------
LARGE_MB = 5 * 1024
#: A star among the outputs of a literal-free text.
STAR = r"\bselect (?:distinct |all |top \? )?\*|, ?\*|[a-z0-9_$\"] ?\. ?\*"


def markers(sql: str | T.Node, catalog: dict[str, dict] | None = None, views: dict[str, str] | None = None) -> list[str]:
    """Names of the patterns that make a statement slow; catalogue-based ones need table figures."""
    tree, catalog, views = _tree(sql), catalog or {}, views or {}
    nodes = list(tree.walk())
    selects = [n for n in nodes if isinstance(n, T.Select)]
    joins = [j for s in selects for j in s.joins]
    out = []
    add = lambda name, ok: out.append(name) if ok else None
    add("select-star", any(isinstance(o.value, T.Star) for s in selects for o in s.outputs))
    wheres = {id(j): s.where for s in selects for j in s.joins}
    add("cross-join", any(j.kind == "cross" and wheres[id(j)] is None for j in joins))
    add("join-no-condition", any(j.kind != "cross" and j.on is None and not j.using for j in joins))
    add("window-functions", any(isinstance(n, T.Call) and n.over for n in nodes))
    add("distinct", any(s.distinct for s in selects))
    add("many-joins", len(joins) >= 8)
    add("many-subqueries", len(selects) - 1 >= 3)
    add("leading-wildcard-like", any(isinstance(n, T.Binary) and n.op.endswith("like") and isinstance(n.right, T.Literal) and n.right.text.startswith("'%") for n in nodes))
    add("hidden-view-joins", any(len(T.tables(T.parse(views[t.key]))) > 1 for t in T.tables(tree) if t.key in views))
    known = {t.alias or t.parts[-1]: catalog[t.key] for t in T.tables(tree) if t.key in catalog}
    large = {a: m for a, m in known.items() if m.get("size_mb", 0) >= LARGE_MB}
    pairs = [p for j in joins for p in T.conjuncts(j.on) if isinstance(p, T.Binary) and p.op == "="]
    sides = [c for p in pairs for c in (p.left, p.right) if isinstance(c, T.Column) and c.qualifier in large]
    add("join-off-distkey", any(large[c.qualifier].get("distkey") not in (None, c.name) for c in sides))
    add("join-off-sortkey", any(large[c.qualifier].get("sortkey") not in (None, c.name) for c in sides))
    calls = [c for s in selects for p in T.conjuncts(s.where) for n in p.walk() if isinstance(n, (T.Call, T.Cast)) for c in n.walk() if isinstance(c, T.Column)]
    add("func-on-sortkey", any(m.get("sortkey") == c.name for c in calls for a, m in known.items() if c.qualifier in (None, a)))
    add("stale-stats", any(m.get("stats_off", 0) >= 10 for m in known.values()))
    add("heavily-unsorted", any(m.get("unsorted_pct", 0) >= 20 for m in known.values()))
    add("data-skew", any(m.get("skew_rows", 0) >= 4 for m in known.values()))
    return out


def text_markers(sql: str, shape: str) -> list[str]:
    """As markers, by regular expressions, for a statement that does not parse; `shape` is its literal-free text."""
    tests = [
        ("select-star", re.search(STAR, shape)),
        ("cross-join", re.search(r"\bcross join\b", shape) and not re.search(r"\bwhere\b", shape)),
        ("window-functions", re.search(r"\bover\s*\(", shape)),
        ("distinct", re.search(r"\bselect distinct\b", shape)),
        ("many-joins", len(re.findall(r"\bjoin\b", shape)) >= 8),
        ("many-subqueries", len(re.findall(r"\(\s*select\b", shape)) >= 3),
        ("leading-wildcard-like", re.search(r"(?i)like\s+'\s*%", sql)),
    ]
    return [name for name, ok in tests if ok]


# Decomposability -------------------------------------------------------------------------------
def decomposability(sql: str, external: frozenset[str] = frozenset()) -> tuple[float, list[str]]:
    """A score from 0 to 1 and the named deductions."""
    try:
        return _scored(T.parse(sql), external)
    except (SyntaxError, RecursionError):
        word = (re.match(r"\s*(\w+)", sql) or [None, ""])[1].lower()
        return (0.10, ["recursive"]) if re.search(r"(?i)\bwith\s+recursive\b", sql) else (0.05, ["not a query"]) if word not in ("select", "with") else (0.30, ["not understood"])


def _scored(tree: T.Node, external: frozenset[str]) -> tuple[float, list[str]]:
    nodes = list(tree.walk())
    selects = [n for n in nodes if isinstance(n, T.Select)]
    tables = T.tables(tree)
    calls = [n for n in nodes if isinstance(n, T.Call)]
    keys = [t.key for t in tables]
    unions = sum(isinstance(n, T.SetOp) for n in nodes)
    ctes = sum(isinstance(n, T.Cte) for n in nodes)
    depth = _depth(tree)
    joins = [j for s in selects for j in s.joins]
    qualified = {c.qualifier is not None for c in nodes if isinstance(c, T.Column)}
    inner = sum(_correlated(n) for n in nodes if isinstance(n, (T.Exists, T.Scalar, T.InQuery)))
    checks = [
        ("json", any(c.name.startswith("json_") for c in calls), 0.50),
        ("correlated subquery", inner > 0, min(0.25 + 0.10 * max(inner - 1, 0), 0.45)),
        ("set operations", unions > 0, 0.20 if unions > 2 else 0.12),
        ("deep WITH", ctes > 3, 0.22 if ctes > 6 else 0.08),
        ("self join", len(set(keys)) < len(keys), 0.15),
        ("external tables", any(k in external for k in keys), 0.15),
        ("no filter", not any(s.where for s in selects), 0.15 if len(tables) > 1 else 0.12),
        ("nesting", depth > 2, 0.20 if depth > 4 else 0.10),
        ("many tables", len(tables) > 8, 0.12),
        ("no table", not tables, 0.25),
        ("window functions", any(c.over for c in calls), 0.10),
        ("star", any(isinstance(o.value, T.Star) for s in selects for o in s.outputs), 0.05),
        ("nondeterministic", any(c.name in ("random", "getdate", "sysdate", "current_timestamp", "now") for c in calls), 0.05),
        ("cross join", any(j.kind == "cross" for j in joins), 0.12),
        ("or", any(isinstance(n, T.Binary) and n.op == "or" for n in nodes), 0.05),
        ("mixed qualification", len(qualified) == 2 and len(tables) > 1, 0.08),
    ]
    hit = [(name, w) for name, ok, w in checks if ok]
    return max(0.0, round(1.0 - sum(w for _, w in hit), 4)), [name for name, _ in hit]


def _depth(n: T.Node) -> int:
    below = max((_depth(c) for c in n.children()), default=0)
    return below + isinstance(n, (T.Derived, T.Scalar, T.InQuery, T.Exists))


def _correlated(n: T.Node) -> bool:
    """Whether a subquery names a source that it does not have."""
    own = {t.alias or t.parts[-1] for t in n.query.walk() if isinstance(t, T.Table)} | {d.alias for d in n.query.walk() if isinstance(d, T.Derived)}
    return any(isinstance(c, T.Column) and c.qualifier and c.qualifier not in own for c in n.query.walk())


# Procedures ------------------------------------------------------------------------------------
_KEEP = {"select", "insert", "update", "delete", "create", "with", "merge", "call", "unload", "copy", "truncate", "drop", "alter"}


def spans(body: str) -> list[tuple[int, int]]:
    """(start, end) of the executable statements of a procedure body; quotes, dollar quotes and comments hide semicolons."""
    out, at, i, n = [], 0, 0, len(body)
    while i <= n:
        if i == n or body[i] == ";":
            a = at
            while m := re.compile(r"\s+|--[^\n]*|/\*.*?\*/|(?:begin|declare|then|else|loop)\b|(?:if|elsif|while|for)\b.*?\b(?:then|loop)\b", re.I | re.S).match(body, a, i):
                a = m.end()
            word = re.compile(r"[a-z]+", re.I).match(body, a, i)
            if word and word[0].lower() in _KEEP:
                out.append((a, i))
            at = i = i + 1
            continue
        if body[i] == "'":
            i = body.find("'", i + 1)
        elif body.startswith("--", i):
            i = body.find("\n", i)
        elif body.startswith("/*", i):
            i = body.find("*/", i) + 1 or -1
        elif m := re.compile(r"\$\w*\$").match(body, i):
            i = body.find(m[0], m.end())
            i = i + len(m[0]) - 1 if i >= 0 else -1
        if i < 0:
            i = n - 1
        i += 1
    return out


def statements(body: str) -> list[str]:
    return [body[a:b].strip() for a, b in spans(body)]


# Batch -----------------------------------------------------------------------------------------
SCHEMA = "sql_hash string, method string, shape string, fingerprint string, tables array<string>, join_columns array<string>, filter_columns array<string>, join_count int, predicate_count int, subquery_count int, wildcard_count int, markers array<string>, decomposability double"


#: A name that WITH defines; the regular expression of tables finds it where it is read.
_DEFINED = re.compile(r"([a-z_#][a-z0-9_$#]*) ?(?:\([^()]*\) ?)?\bas ?\( ?(?:select|with)\b")


def _read(sql: str) -> tuple | None:
    """Shape, fingerprint, features, markers and decomposability from one reading; None if it is not understood."""
    try:
        tree = T.parse(sql)
        f = features(tree)
        found = [f[c] for c in ("tables", "join_columns", "filter_columns", "join_count", "predicate_count", "subquery_count", "wildcard_count")]
        return (literal_free(tree), _digest(order_free(tree)), *found, markers(tree), _scored(tree, frozenset())[0])
    except (SyntaxError, RecursionError):
        return None


def _analyse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    read = Shared(_read)
    for pdf in batches:
        rows = []
        for key, text, shape, tables, *counts in pdf.itertuples(index=False):
            oversize = len(text) > MOST_CHARS
            found = read(text)[0]
            if found:
                rows.append((key, "regex-oversize" if oversize else "ast", shape if oversize else found[0], *found[1:]))
            else:
                defined = set(_DEFINED.findall(shape))
                rows.append((key, "regex-oversize" if oversize else "regex", shape, fingerprint(text), [t for t in tables.split(", ") if t and t not in defined], [], [], *counts, text_markers(text, shape), decomposability(text)[0]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def analysed(queries: DataFrame) -> DataFrame:
    """Facts of each distinct statement of `queries` (sql_text), keyed by its SHA-256."""
    body = shapes.unloaded("sql_text")
    distinct = queries.where(F.col("sql_text").isNotNull()).select(F.sha2("sql_text", 256).alias("sql_hash"), body.alias("sql_text")).dropDuplicates(["sql_hash"])
    # parsing is CPU-bound: the rows are few bytes, but should fill every core
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = grouping.features(distinct.repartition(n, "sql_hash"))
    return plain.select("sql_hash", "sql_text", "shape", "sql_tables", "join_count", "predicate_count", "subquery_count", F.regexp_count("shape", F.lit(STAR)).alias("wildcard_count")).mapInPandas(_analyse, SCHEMA)


def _split_series(s: pd.Series) -> pd.Series:
    return s.map(lambda x: statements(x or ""))


def procedure_statements(procedures: DataFrame) -> DataFrame:
    """One row per executable statement: procedure_key, statement_no, sql_text."""
    split = F.pandas_udf(_split_series, ty.ArrayType(ty.StringType()))
    return procedures.select("procedure_key", F.posexplode(split(F.coalesce(shapes.procedure_body("source_definition"), "source_definition"))).alias("statement_no", "sql_text"))

