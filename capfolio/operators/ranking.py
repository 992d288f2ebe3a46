"""Top or bottom schedules and budget lines by a metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capfolio.functions.joins import join_many_to_one
from capfolio.functions.signs import direction as direction_of
from capfolio.operators.derive import within_variance_guard
from capfolio.operators.scope import ENTITIES, one_of, resolve_scope

SCHEDULE_METRICS = ("period_variance_days", "cumulative_variance_days")
# Metric to column; the last two are signed and carry a direction.
BUDGET_METRICS = {
    "total_budget": "latest_budget",
    "spend_to_date": "spend_to_date",
    "spend_pct": "spend_pct",
    "budget_variance": "budget_variance",
    "cumulative_budget_change": "cumulative_budget_change",
}
SIGNED = ("budget_variance", "cumulative_budget_change")


def pids_in_category(tables, category: str) -> DataFrame:
    """Schedules ever linked to a line of the category, each once."""
    lines = tables["category_dim"].where(F.col("category") == category).select("fms_id")
    linked = join_many_to_one(tables.edge_rows().select("pid", "fms_id"), lines, ["fms_id"], "left_semi")
    return linked.select("pid").distinct()


def _within(frame: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    if low is not None:
        frame = frame.where(F.col(column) >= low)
    if high is not None:
        frame = frame.where(F.col(column) <= high)
    return frame


def rank_projects(
    tables,
    entity: str,
    rank_by: str,
    n: int = 10,
    direction: str = "top",
    min_total_budget: float | None = None,
    max_total_budget: float | None = None,
    delayed_only: bool = False,
    category: str | None = None,
    agency: str | None = None,
    agency_role: str = "auto",
) -> DataFrame:
    """The ``n`` best or worst rows; ties go by id. A bounded heap per task, no full sort."""
    one_of("entity", entity, ENTITIES)
    one_of("direction", direction, ("top", "bottom"))
    scope = resolve_scope(tables, agency, agency_role, entity) if agency is not None else None
    rank = _rank_schedules if entity == "schedule" else _rank_lines
    rows, ids = rank(
        tables, rank_by, min_total_budget, max_total_budget, delayed_only, category, scope
    )
    order = F.desc(rank_by) if direction == "top" else F.asc(rank_by)
    return rows.orderBy(order, *[F.asc_nulls_last(i) for i in ids]).limit(max(1, int(n)))


def _rank_schedules(tables, rank_by, low, high, delayed_only, category, scope):
    one_of("rank_by", rank_by, SCHEDULE_METRICS)
    if category is not None:
        # The details are read for the state, for its funding and for the links to the category: put together once.
        shown = ("pid", "managing_agency", "sponsor_agency", "attributed_budget", "period_variance_days")
        read = [c for c in shown if c != "sponsor_agency" or scope is not None]
        state_alone = rank_by == "period_variance_days"
        tables = tables.sharing(
            {"latest_project_state": 1} if state_alone else {},
            {"latest_project_state": read},
            {"category_dim": F.col("category") == category},
            current=True,
        )
    state = tables["latest_project_state"]
    if rank_by == "cumulative_variance_days":
        # Only schedules with a figure can rank, so this need not keep the others.
        sums = tables["cumulative_schedule_variance"].select("pid", rank_by)
        state = state.join(sums, "pid")
    rows = state.where(within_variance_guard(F.col(rank_by)))
    rows = _within(rows, "attributed_budget", low, high)
    if delayed_only:
        rows = rows.where(F.col("period_variance_days") > 0)
    if scope is not None:
        rows = scope.apply(rows)
    if category is not None:
        rows = rows.join(pids_in_category(tables, category), "pid", "left_semi")
    shown = rows.select(
        "pid", "managing_agency", "attributed_budget", rank_by,
        direction_of(F.col(rank_by)).alias("direction"),
    )
    return shown, ["pid"]


def _rank_lines(tables, rank_by, low, high, delayed_only, category, scope):
    one_of("rank_by", rank_by, BUDGET_METRICS)
    column = BUDGET_METRICS[rank_by]
    rows = tables["lifetime_budget_variance"].where(F.col(column).isNotNull())
    rows = _within(rows, "latest_budget", low, high)
    if delayed_only:
        late = tables["latest_project_state"].where(F.col("period_variance_days") > 0).select("pid")
        linked = join_many_to_one(tables["link_edges"], late, ["pid"], "left_semi")
        rows = rows.join(linked.select("fms_id").distinct(), "fms_id", "left_semi")
    if category is not None:
        kind = tables["category_dim"].where(F.col("category") == category).select("fms_id")
        rows = rows.join(kind, "fms_id", "left_semi")
    extra = [direction_of(F.col(rank_by), "budget").alias("direction")] if rank_by in SIGNED else []
    if scope is not None and scope.role == "sponsor":
        # One aggregate of the owner bridge gives both the filter and each line's full
        # owner list. Owners are agency names, so the list is as short as the dictionary.
        owners = (
            scope.owners.groupBy("fms_id")
            .agg(F.sort_array(F.collect_set("sponsor_agency")).alias("sponsor_agencies"))
            .where(
                F.arrays_overlap(
                    "sponsor_agencies", F.array(*[F.lit(v) for v in scope.variants])
                )
            )
        )
        rows = rows.join(owners, "fms_id")
        extra.append(F.col("sponsor_agencies"))
    elif scope is not None:
        rows = scope.apply(rows)
    shown = rows.withColumn(rank_by, F.col(column)).select(
        "fms_id", "managing_agency", rank_by, *extra
    )
    return shown, ["fms_id", "managing_agency"]
