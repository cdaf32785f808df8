"""Queries over the typed layer. The stored tables are made up of text by a rule over orders, with tokens for null and values that do not fit."""

from __future__ import annotations

import re

from ..functions.exprs import YEAR_SECONDS
from ..sources import silver

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_TOKENS = "case when (k + {i}) % 7 = 0 then 'NULL' when (k + {i}) % 11 = 0 then '' when (k + {i}) % 13 = 0 then ' None ' else {v} end"
_VALUES = {
    "text": "' V' || cast((k + {i}) % 17 as varchar(20)) || ' x '",
    "raw": "'  Part ' || cast((k * {i}) % 23 as varchar(20)) || '  '",
    "long": "case when (k + {i}) % 5 = 0 then 'many' else ' ' || cast((k * 31 + {i}) % 100003 as varchar(20)) end",
    "real": "case when (k + {i}) % 5 = 0 then 'n/a' else cast((k * 17 + {i}) % 9973 as varchar(20)) || '.5' end",
    "time": "case when (k + {i}) % 5 = 0 then 'soon' else '2024-0' || cast(k % 9 + 1 as varchar(4)) || '-1' || cast((k + {i}) % 10 as varchar(4)) || ' 0' || cast(k % 10 as varchar(4)) || ':30:00' end",
}


def bronze(view: str) -> str:
    """The stored table of a view: every column text; those of the highest numbers are lacking."""
    names = list(silver.stored(view).items())
    kept = names if len(names) < 12 else names[:-1]
    return "select " + ", ".join(f"{_TOKENS.format(i=i, v=_VALUES[kind].format(i=i))} as {c}_" for i, (c, kind) in enumerate(kept, 1)) + " from (select o_orderkey as k from {orders}) o"


def _oracle(view: str) -> str:
    names = list(silver.stored(view))
    lacking = set() if len(names) < 12 else {names[-1]}
    text = lambda c: "cast(null as varchar)" if c in lacking else f"nullif(nullif(nullif(trim({c}_), ''), 'None'), 'NULL')"
    kept = lambda c: "cast(null as varchar)" if c in lacking else f"case when trim({c}_) not in ('', 'None', 'NULL') then {c}_ end"
    cast = {"text": text, "raw": kept, "long": lambda c: f"try_cast({text(c)} as bigint)", "real": lambda c: f"try_cast({text(c)} as double)", "time": lambda c: f"try_cast({text(c)} as timestamp)"}
    first = lambda choice, kind="text": f"coalesce({', '.join(cast[kind](c) for c in choice.split('|'))})"
    dotted = lambda xs: " || '.' || ".join(f"coalesce({first(x)}, '')" for x in xs)
    out = []
    for name, source, kind in silver.columns(view):
        call, _, inner = source.rstrip(")").partition("(")
        if call == "seconds" and inner:
            v = cast["real"](inner)
            sql = f"case when abs({v}) / 1e6 <= {YEAR_SECONDS} then {v} / 1e6 end"
        elif call == "ratio" and inner:
            a, b = (cast["real"](c) for c in inner.split("/"))
            sql = f"case when {b} > 0 then {a} / {b} end"
        elif call == "key" and inner:
            parts = inner.split(".")
            sql = f"lower({dotted(parts)})"
            if parts[1].startswith("procedure_key|"):
                sql = f"case when {text('procedure_key')} is not null then lower(coalesce({text(parts[0])}, '') || '.' || {text('procedure_key')}) else lower({dotted([parts[0], parts[1].partition('|')[2], *parts[2:]])}) end"
        else:
            sql = first(source, kind)
        out.append(f'{sql} as "{name}"')
    if view == "query_explain":
        out.append(f"lower(coalesce({kept('plan_node')}, '') || ' ' || coalesce({kept('plan_info')}, '')) as plan_text_lc")
    where = f" where {cast['long']('query_id')} is not null" if view in ("query_explain", "query_detail_flow") else ""
    return f"with bronze as ({re.sub(r'{(\w+)}', r'\1', bronze(view))}) select {', '.join(out)} from bronze{where}"


def _register(view: str) -> None:
    def run(spark, sf):
        made = spark.sql(re.sub(r"{(\w+)}", lambda m: f"parquet.`{sf}/{m[1]}.parquet`", bronze(view)))
        return silver.view(made.toDF(*[c[:-1] for c in made.columns]), view)

    QUERIES[f"silver_{view}"] = run
    ORACLES[f"silver_{view}"] = _oracle(view)


for _view in silver.VIEWS:
    _register(_view)
