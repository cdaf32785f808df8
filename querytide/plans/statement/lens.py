"""A lens on one statement: its tables, joins and filters against the catalogue, findings and first steps."""

from __future__ import annotations

import re

from . import tree as T
from .facts import markers
from .rewrites import Catalog, Meta
from .views import footprint, lookup


def _scope(s: T.Select, catalog: Catalog) -> dict[str, tuple[str, Meta]]:
    out = {}
    for x in T.sources(s):
        if isinstance(x, T.Table):
            key = lookup(catalog, x.key)
            out[x.alias or x.parts[-1]] = (key or x.key, catalog.get(key or "", Meta()))
    return out


def joins(sql: str, catalog: Catalog) -> list[dict]:
    """Equalities between sources with their verdict: aligned, collocated or misaligned (and how large)."""
    out = []
    for s in (n for n in T.parse(sql).walk() if isinstance(n, T.Select)):
        scope = _scope(s, catalog)
        pairs = [(j.kind, p) for j in s.joins for p in T.conjuncts(j.on)] + [("where", p) for p in T.conjuncts(s.where)]
        for kind, p in pairs:
            if not (isinstance(p, T.Binary) and p.op == "=" and isinstance(p.left, T.Column) and isinstance(p.right, T.Column)) or p.left.qualifier == p.right.qualifier:
                continue
            (lk, lm), (rk, rm) = (scope.get(c.qualifier or "", (c.qualifier or "?", Meta())) for c in (p.left, p.right))
            keyed = lm.distkey == p.left.name and rm.distkey == p.right.name
            verdict = "aligned" if keyed else "collocated" if "ALL" in (lm.distkey, rm.distkey) else "large misaligned" if max(lm.size_mb, rm.size_mb) >= 1024 else "misaligned"
            out.append({"kind": kind, "left": f"{lk}.{p.left.name}", "right": f"{rk}.{p.right.name}", "verdict": verdict})
    return out


def predicates(sql: str, catalog: Catalog) -> list[dict]:
    """Filters with the clause they stand in and whether they meet a sort key bare, wrapped or not at all."""
    out = []
    for s in (n for n in T.parse(sql).walk() if isinstance(n, T.Select)):
        scope = _scope(s, catalog)
        for clause, tree in (("where", s.where), ("having", s.having), ("qualify", s.qualify)):
            for p in T.conjuncts(tree):
                cols = [c for c in p.walk() if isinstance(c, T.Column)]
                if isinstance(p, T.Binary) and p.op == "=" and isinstance(p.left, T.Column) and isinstance(p.right, T.Column):
                    continue
                wrapped = {c.name for n in p.walk() if isinstance(n, (T.Call, T.Cast)) for c in n.walk() if isinstance(c, T.Column)}
                keys = {c.name for c in cols for a, (_, m) in scope.items() if c.qualifier in (None, a) and c.name in m.sortkeys}
                out.append({"clause": clause, "predicate": T.sql(p), "sortkey": "wrapped" if keys & wrapped else "used" if keys else "none"})
    return out


def first_steps(sql: str, catalog: Catalog, views: dict[str, str] | None = None) -> list[str]:
    """What to look at first, in order."""
    out = []
    js, ps, ms = joins(sql, catalog), predicates(sql, catalog), markers(sql, views=views)
    out += [f"Align {j['left']} with {j['right']}" for j in js if j["verdict"] == "large misaligned"]
    out += [f"Compare the bare column: {p['predicate']}" for p in ps if p["sortkey"] == "wrapped"]
    names = {"select-star": "List the columns", "cross-join": "Give the join a condition", "leading-wildcard-like": "Avoid the leading wildcard", "distinct": "Check whether DISTINCT is needed", "many-joins": "Stage the joins"}
    return out + [names[m] for m in ms if m in names]


def diagram(sql: str, catalog: Catalog, views: dict[str, str] | None = None) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
    """Nodes (object, kind) and edges (left, right, verdict)."""
    nodes = sorted({(o, k) for o, k, _, _ in footprint(sql, views or {})})
    return nodes, [(j["left"].rsplit(".", 1)[0], j["right"].rsplit(".", 1)[0], j["verdict"]) for j in joins(sql, catalog)]


def equality_colors(sql: str, catalog: Catalog) -> list[tuple[str, str]]:
    """Each joined side: red for a large table off its sort key, yellow for a large one on it, green else."""
    out = []
    for s in (n for n in T.parse(sql).walk() if isinstance(n, T.Select)):
        scope = _scope(s, catalog)
        for p in [p for j in s.joins for p in T.conjuncts(j.on)]:
            if isinstance(p, T.Binary) and p.op == "=":
                for c in (p.left, p.right):
                    if isinstance(c, T.Column) and c.qualifier in scope:
                        m = scope[c.qualifier][1]
                        large = m.size_mb >= 1024
                        out.append((T.sql(c), "green" if not large else "yellow" if c.name in m.sortkeys else "red"))
    return out


def token_at(sql: str, at: int) -> str:
    """The dotted name around a position."""
    for m in re.finditer(r'[\w$"]+(?:\s*\.\s*[\w$"]+)*', sql):
        if m.start() <= at < m.end():
            return re.sub(r'["\s]', "", m[0]).lower()
    return ""


def comparison_at(sql: str, at: int) -> tuple[str, str] | None:
    """The two sides of the comparison around a position."""
    for m in re.finditer(r"([\w.$\"]+)\s*(?:=|<>|<=|>=|<|>)\s*([\w.$\"']+)", sql):
        if m.start() <= at < m.end():
            return m[1].lower(), m[2].lower()
    return None
