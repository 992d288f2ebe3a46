"""What changed between two reporting periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capfolio.functions.casts import money_sum
from capfolio.functions.periods import is_cadence_period
from capfolio.functions.signs import direction
from capfolio.functions.text import same_text
from capfolio.operators.breakdowns import BUDGET_METRICS
from capfolio.operators.scope import one_of, scoped

CHANGE_TYPES = ("completed", "delayed")
FINISHED = ("completed", "cancelled")


def schedule_changes(
    tables,
    change_type: str,
    from_period: str,
    to_period: str,
    agency: str | None = None,
    include_cancelled: bool = False,
    agency_role: str = "auto",
    check_data: bool = True,
) -> DataFrame:
    """Schedules newly finished, or newly late, at ``to_period`` compared with ``from_period``.

    A schedule absent at ``from_period`` counts as neither finished nor late then. Both
    periods are read in one pass and paired by one aggregate, instead of joining the
    history to itself. ``check_data`` runs a small job that rejects a ``to_period``
    without any schedule.
    """
    one_of("change_type", change_type, CHANGE_TYPES)
    if not (is_cadence_period(from_period) and is_cadence_period(to_period)):
        raise ValueError("periods must be YYYYMM with month 01, 05 or 09")
    if from_period >= to_period:
        raise ValueError("from_period must be earlier than to_period")
    history = tables["schedule_history"]
    if check_data and not tables.has_schedules(to_period):
        raise ValueError(f"no schedule data at to_period {to_period}")

    period = F.col("reporting_period")
    measure = "lifecycle_status" if change_type == "completed" else "variance_day"
    now = F.struct("managing_agency", "sponsor_agency", measure)
    pairs = (
        history.where(period.isin(from_period, to_period))
        .groupBy("pid")
        .agg(
            F.max(F.when(period == to_period, now)).alias("now"),
            F.max(F.when(period == from_period, F.col(measure))).alias("before"),
        )
        .where(F.col("now").isNotNull())
        .select("pid", "now.*", "before")
    )
    pairs = scoped(tables, pairs, agency, agency_role, "schedule")
    before = F.col("before")
    if change_type == "completed":
        reached = FINISHED if include_cancelled else FINISHED[:1]
        pairs = pairs.where(F.col(measure).isin(*reached)).where(
            before.isNull() | ~before.isin(*FINISHED)
        )
    else:
        pairs = pairs.where((F.col(measure) > 0) & (before.isNull() | (before <= 0)))
    return pairs.select("pid", "managing_agency", measure)


def schedule_change_notes(tables, from_period: str) -> list[str]:
    """What a reader of ``schedule_changes`` should know; stops at the first row of the earlier period."""
    if tables.has_schedules(from_period):
        return []
    return [f"no schedule data at from_period {from_period}: all that is finished or late at to_period counts as new"]


def budget_change_notes(target: str, agency_role: str = "auto") -> list[str]:
    """What a reader of ``budget_change`` should know."""
    if target.startswith("agency:") and agency_role != "managing":
        return ["an owner's lines are those of its current schedules, for both periods"]
    return []


def _change_columns(metric: str, from_period: str, to_period: str) -> list[Column]:
    amount, period = F.col(BUDGET_METRICS[metric]), F.col("reporting_period")
    return [
        money_sum(F.when(period == from_period, amount)).alias("from_value"),
        money_sum(F.when(period == to_period, amount)).alias("to_value"),
    ]


def _with_delta(sums: DataFrame) -> DataFrame:
    """The change, NULL unless both periods have data."""
    delta = F.col("to_value") - F.col("from_value")
    return sums.withColumn("change_value", delta).withColumn(
        "change_direction", direction(F.col("change_value"), "budget")
    )


def budget_change(
    tables,
    target: str,
    from_period: str,
    to_period: str,
    metric: str = "total_budget",
    agency_role: str = "auto",
) -> DataFrame:
    """One row: the metric of ``agency:<name>`` or ``fms:<line>`` in both periods.

    A sponsor's lines are its current ones, also for the earlier period.
    """
    one_of("metric", metric, BUDGET_METRICS)
    kind, _, value = target.partition(":")
    if kind not in ("agency", "fms") or not value:
        raise ValueError("target must be 'agency:<name>' or 'fms:<line id>'")
    rows = tables["budget_history"].where(F.col("reporting_period").isin(from_period, to_period))
    if kind == "agency":
        rows = scoped(tables, rows, value, agency_role, "budget")
    else:
        rows = rows.where(same_text(F.col("fms_id"), value))
    sums = rows.agg(*_change_columns(metric, from_period, to_period))
    return _with_delta(sums).select(
        F.lit(target).alias("target"),
        F.lit(from_period).alias("from_period"),
        F.lit(to_period).alias("to_period"),
        "from_value", "to_value", "change_value", "change_direction",
    )


def budget_changes_by(
    tables, key: str, from_period: str, to_period: str, metric: str = "total_budget"
) -> DataFrame:
    """``budget_change`` for every target at once: all holders, or all lines (any case)."""
    one_of("metric", metric, BUDGET_METRICS)
    one_of("key", key, ("managing_agency", "fms_id"))
    rows = tables["budget_history"].where(F.col("reporting_period").isin(from_period, to_period))
    group = F.lower("fms_id").alias("fms_id") if key == "fms_id" else F.col(key)
    return _with_delta(rows.groupBy(group).agg(*_change_columns(metric, from_period, to_period)))
