"""Grouped figures for one reporting period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from capfolio.functions.casts import money_sum
from capfolio.functions.joins import join_many_to_one
from capfolio.functions.medians import histogram, with_medians
from capfolio.functions.signs import direction
from capfolio.functions.text import owner_atoms
from capfolio.operators.scope import one_of, scoped

SCHEDULE_GROUPS = (
    "managing_agency", "sponsor_agency", "borough", "phase_norm", "lifecycle_status", "category",
)
VARIANCE_STATISTICS = {
    "count": F.count,
    "mean": F.avg,
    "median": None,  # selected from counts per value, see exact_medians
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
}
BUDGET_GROUPS = ("managing_agency", "category")
BUDGET_METRICS = {"total_budget": "total_budget", "spend": "spend_to_date"}


def schedule_breakdown(
    tables,
    group_by: str,
    metric: str = "count",
    statistic: str = "count",
    period: str = "current",
    agency: str | None = None,
    agency_role: str = "auto",
) -> DataFrame:
    """Schedules of one period by group: ``value``, ``n`` and, for day figures, ``direction``.

    A composite sponsor counts under each single owner, and a schedule whose lines span
    categories counts once in each, so those two groupings do not add up to a total.
    """
    one_of("group_by", group_by, SCHEDULE_GROUPS)
    one_of("metric", metric, ("count", "schedule_variance"))
    if metric == "schedule_variance":
        one_of("statistic", statistic, VARIANCE_STATISTICS)
    at = tables.period("schedule_history", period)
    rows = tables["schedule_history"].where(F.col("reporting_period") == at)
    rows = scoped(tables, rows, agency, agency_role, "schedule")
    if group_by == "sponsor_agency":
        rows = rows.withColumn(group_by, F.explode(owner_atoms(F.col(group_by))))
        rows = rows.where(F.col(group_by) != "")
    elif group_by == "category":
        funded = tables["link_edges"].where(F.col("reporting_period") == at)
        kinds = join_many_to_one(funded, tables["category_dim"], ["fms_id"])
        kinds = kinds.select("pid", "category").distinct()
        rows = rows.join(kinds, "pid")
    if metric == "schedule_variance" and statistic == "median":
        counts = histogram(rows, [group_by], "variance_day")
        groups = with_medians(counts.groupBy(group_by).agg(F.sum("n").alias("n")), counts, [group_by], "variance_day")
        groups = groups.select(group_by, F.col("median").alias("value"), "n")
    else:
        value = VARIANCE_STATISTICS[statistic]("variance_day") if metric == "schedule_variance" else F.count("*")
        groups = rows.groupBy(group_by).agg(value.alias("value"), F.count("*").alias("n"))
    if metric == "schedule_variance" and statistic != "count":
        groups = groups.withColumn("direction", direction(F.col("value")))
    return groups.orderBy(F.desc_nulls_last("value"), F.asc_nulls_last(group_by))


def delay_reasons(
    tables,
    period: str = "current",
    agency: str | None = None,
    scope: str = "current",
    agency_role: str = "auto",
) -> DataFrame:
    """How often each reason is given for a later completion, in one period or over all."""
    rows = tables["schedule_history"].where(
        (F.col("variance_day") > 0) & F.col("reason_for_delay").isNotNull()
    )
    if scope != "all_history":
        rows = rows.where(F.col("reporting_period") == tables.period("schedule_history", period))
    rows = scoped(tables, rows, agency, agency_role, "schedule")
    return (
        rows.groupBy("reason_for_delay")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "reason_for_delay")
    )


def budget_breakdown(
    tables,
    group_by: str = "managing_agency",
    metric: str = "total_budget",
    period: str = "current",
    agency: str | None = None,
    agency_role: str = "auto",
) -> DataFrame:
    """Budget or spend of one period by holder or category.

    Snapshots are unique per (line, agency, period) and a line has one category, so
    every line counts exactly once without another distinct.
    """
    one_of("group_by", group_by, BUDGET_GROUPS)
    one_of("metric", metric, BUDGET_METRICS)
    at = tables.period("budget_history", period)
    rows = tables["budget_history"].where(F.col("reporting_period") == at)
    rows = scoped(tables, rows, agency, agency_role, "budget")
    if group_by == "category":
        rows = rows.join(tables["category_dim"], "fms_id")
    return (
        rows.groupBy(group_by)
        .agg(money_sum(F.col(BUDGET_METRICS[metric])).alias("value"), F.count("*").alias("n"))
        .orderBy(F.desc_nulls_last("value"), F.asc_nulls_last(group_by))
    )


def list_categories(tables) -> DataFrame:
    """Lines, budget and share of the total per category at the newest budget period.

    The window over all groups sees one row per category, a number fixed by the taxonomy.
    """
    at = tables.period("budget_history", "current")
    rows = tables["budget_history"].where(F.col("reporting_period") == at)
    groups = (
        rows.join(tables["category_dim"], "fms_id")
        .groupBy("category")
        .agg(F.count("*").alias("n_budget_lines"), money_sum(F.col("total_budget")).alias("b"))
    )
    whole = F.sum("b").over(W.partitionBy())
    return groups.select(
        "category",
        "n_budget_lines",
        F.round("b", 0).alias("total_budget"),
        F.round(F.lit(100.0) * F.col("b") / whole, 1).alias("pct_budget"),
    ).orderBy(F.desc_nulls_last("total_budget"), "category")
