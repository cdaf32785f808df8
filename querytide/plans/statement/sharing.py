"""Statements that differ only in their literals are read once.

A statement's form is its text with each literal replaced by a mark: equal literals have equal marks, and what a tool may
tell apart stays as it is (dates, four digits, names of date parts, a leading % and, beside casts, every number). A tool
runs on the form; the literals are put back into its texts.
"""

from __future__ import annotations

from collections.abc import Callable
from re import compile as pattern

from .tree import _TOKEN

MARK = "904172635"
#: Forms that a task remembers, and the longest text that has one.
MOST, MOST_CHARS = 4096, 8000
_MARKED = pattern(rf"'%?{MARK}(\d{{4}})'|{MARK}(\d{{4}})")
_TOLD = pattern(r"'\d{4}-\d{2}-\d{2}[^']*'|'[A-Za-z]+'|\d{4}")
_CASTS = pattern(r"(?i)::|\bcast\b")


def form(sql: str) -> tuple[str, list[str]] | None:
    """(form, literals); None if the text is long, holds the mark or is no sequence of tokens."""
    if len(sql) > MOST_CHARS or MARK in sql:
        return None
    casts, at, out, literals, places = _CASTS.search(sql), 0, [], [], {}
    for m in _TOKEN.finditer(sql):
        if m.start() != at:
            return None
        at, kind, text = m.end(), m.lastgroup, m[0]
        if kind == "space":
            continue
        if (kind == "text" or (kind == "number" and not casts)) and not _TOLD.fullmatch(text):
            if text not in places:
                places[text] = f"{len(literals):04d}"
                literals.append(text)
            text = f"{MARK}{places[text]}" if kind == "number" else f"'{'%' * text.startswith(chr(39) + '%')}{MARK}{places[text]}'"
        out.append(text)
    return (" ".join(out), literals) if at == len(sql) and len(literals) < 10_000 else None


class Shared:
    """Calls `tool` once for each form and gives its result with a function that puts a statement's literals back."""

    def __init__(self, tool: Callable[[str], object]) -> None:
        self.tool, self.known = tool, {}

    def __call__(self, sql: str) -> tuple[object, Callable[[str], str]]:
        found = form(sql)
        if found is None:
            return self.tool(sql), str
        text, literals = found
        if text not in self.known:
            if len(self.known) >= MOST:
                self.known.clear()
            self.known[text] = self.tool(text)
        return self.known[text], lambda s: _MARKED.sub(lambda m: literals[int(m[1] or m[2])], s)
