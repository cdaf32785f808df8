"""Reports of several frames: what a load brought, and how a later report merges into an earlier one."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The areas whose load settles each frame of a report. A frame of no area comes with every load.
_CORE = ("slow_queries", "repeat_queries", "sql_lens")
_TEXTS = ("sql_lens", "repeat_queries")
AREAS: dict[str, tuple[str, ...]] = {
    "slow_queries": _CORE,
    "query_explain": _CORE,
    "query_detail_flow": _CORE,
    "insights": ("insights",),
    "family_summary": ("insights",),
    "table_risk": ("table_risk", "sql_lens"),
    "table_impact": ("table_impact",),
    "table_review": ("table_review", "sql_lens", "repeat_queries"),
    "table_heatmap": ("table_heatmap",),
    "external_table_metadata": ("table_heatmap",),
    "external_tables": ("external_tables",),
    "view_definitions": _TEXTS,
    "procedure_definitions": _TEXTS,
    "table_status": (),
    "action_queue": ("action_plan",),
    "rewrites": ("action_plan",),
    "repeat_groups": ("repeat_queries",),
    "repeat_members": ("repeat_queries",),
    "repeat_group_tables": ("repeat_queries",),
    "flow_edges": _CORE,
    "query_heatmap": _CORE,
}
ABSENT, EMPTY, ROWS = "absent", "empty", "rows"


@dataclass(frozen=True)
class Report:
    """Frames by name, and what they were made from. A frame that a load did not bring is not in `frames`."""

    source: str
    frames: dict[str, DataFrame]
    areas: frozenset[str] = frozenset()
    snapshot: str = ""
    scope: tuple[str, ...] = ()
    summary: dict[str, object] = field(default_factory=dict)
    rule_count: int = 0
    notes: tuple[str, ...] = ()
    errors: tuple[str, ...] = ()

    def trusts(self, name: str) -> bool:
        """Whether this report's frame counts even if it is empty: its area was loaded, or it comes with every load."""
        return AREAS.get(name) == () or bool(self.areas.intersection(AREAS.get(name, ())))


def some_rows(df: DataFrame) -> DataFrame:
    """One row, `some`: whether `df` has rows. Reads until the first."""
    return df.select(F.lit(1)).limit(1).agg((F.count("*") > 0).alias("some"))


def rows_or(first: DataFrame, other: DataFrame) -> DataFrame:
    """`first`, or `other` where `first` has no rows. The branch is in the plan: nothing runs here.

    `other` is kept by a scalar subquery, which is evaluated once, before its scan is read."""
    return first.unionByName(other.where(~some_rows(first).scalar()), allowMissingColumns=True)


def ledger(report: Report) -> DataFrame:
    """(frame, state, trusted) of every known frame: absent, empty or with rows."""
    spark = next(iter(report.frames.values())).sparkSession
    names = [*AREAS, *(x for x in report.frames if x not in AREAS)]
    out = None
    for name in names:
        state = F.lit(ABSENT) if name not in report.frames else F.when(some_rows(report.frames[name]).scalar(), ROWS).otherwise(EMPTY)
        row = spark.range(1).select(F.lit(name).alias("frame"), state.alias("state"), F.lit(report.trusts(name)).alias("trusted"))
        out = row if out is None else out.unionByName(row)
    return out


def merged(base: Report | None, update: Report) -> Report:
    """`update`, with what it did not settle from `base`.

    Another source, another snapshot (where both name one) or another scope takes nothing from the base. Else, frame by
    frame: absent in the update, the base's; trusted, the update's, rows or not; else the update's rows if it has any,
    or the base's."""
    if base is None or base.source != update.source or base.scope != update.scope:
        return update
    if base.snapshot and update.snapshot and base.snapshot != update.snapshot:
        return update
    frames = dict(base.frames)
    for name, frame in update.frames.items():
        frames[name] = frame if update.trusts(name) or name not in base.frames else rows_or(frame, base.frames[name])
    unique = lambda *lists: tuple(dict.fromkeys(x for y in lists for x in y))
    return replace(
        update, frames=frames, snapshot=update.snapshot or base.snapshot, areas=base.areas | update.areas, summary=base.summary | update.summary,
        notes=unique(base.notes, update.notes), errors=unique(base.errors, update.errors),
    )
