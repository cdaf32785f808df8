"""Registered telemetry queries and their equivalent SQL."""

from __future__ import annotations

from . import assemblies, core, designs, externals, flows, groups, layers, lookup_queries, merges, stores, texts, tools

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (core, groups, externals, designs, stores, texts, lookup_queries, layers, tools, merges, assemblies, flows):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
