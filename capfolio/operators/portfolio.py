"""A filtered cross-section of schedules: rows and a summary of the whole set."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capfolio.functions.casts import money_sum
from capfolio.functions.joins import join_many_to_one
from capfolio.functions.signs import direction
from capfolio.operators.ranking import pids_in_category
from capfolio.operators.scope import one_of, scoped

LIFECYCLES = ("in_progress", "completed", "cancelled")


@dataclass(frozen=True)
class PortfolioFilter:
    """Conditions on the latest state; all given ones must hold."""

    category: str | None = None
    borough: str | None = None
    community_board: str | None = None
    lifecycle_status: str | None = None
    agency: str | None = None
    agency_role: str = "auto"


def matching_projects(tables, wanted: PortfolioFilter) -> DataFrame:
    rows = tables["latest_project_state"]
    if wanted.lifecycle_status is not None:
        one_of("lifecycle_status", wanted.lifecycle_status, LIFECYCLES)
        rows = rows.where(F.col("lifecycle_status") == wanted.lifecycle_status)
    if wanted.borough is not None:
        rows = rows.where(
            F.array_contains("boroughs", wanted.borough) | (F.col("borough") == wanted.borough)
        )
    rows = scoped(tables, rows, wanted.agency, wanted.agency_role, "schedule")
    if wanted.category is not None:
        rows = rows.join(pids_in_category(tables, wanted.category), "pid", "left_semi")
    if wanted.community_board is not None:
        places = tables["fms_location"].where(F.col("community_board") == wanted.community_board)
        line = ["fms_id", "managing_agency"]
        there = join_many_to_one(tables.edge_rows().select("pid", *line), places, line, "left_semi")
        rows = rows.join(there.select("pid").distinct(), "pid", "left_semi")
    return rows


def filter_uses(wanted: PortfolioFilter) -> Counter:
    """The tables that the conditions read."""
    uses: Counter = Counter()
    if wanted.category is not None:
        uses.update(("link_edges", "category_dim"))
    if wanted.community_board is not None:
        uses.update(("link_edges", "fms_location"))
    return uses


def filter_columns(wanted: PortfolioFilter) -> list[str]:
    """The columns of the latest state that the conditions read."""
    columns = ["lifecycle_status"] if wanted.lifecycle_status is not None else []
    if wanted.borough is not None:
        columns += ["borough", "boroughs"]
    if wanted.agency is not None:
        columns += ["managing_agency", "sponsor_agency"]
    return columns


def filter_rows(wanted: PortfolioFilter) -> dict[str, Column]:
    """The rows that the conditions read of the tables by line."""
    rows = {}
    if wanted.category is not None:
        rows["category_dim"] = F.col("category") == wanted.category
    if wanted.community_board is not None:
        rows["fms_location"] = F.col("community_board") == wanted.community_board
    return rows


def portfolio_rows(tables, wanted: PortfolioFilter = PortfolioFilter(), n: int | None = None) -> DataFrame:
    """Matching schedules, nearest completion first, undated ones last; all, or the first ``n``."""
    shown = (
        "pid", "agency_project_name", "managing_agency", "sponsor_agency", "borough", "boroughs", "lifecycle_status",
        "current_phase", "completion_date", "completion_date_type", "period_variance_days", "attributed_budget",
    )
    tables = tables.sharing({"latest_project_state": 1}, {"latest_project_state": shown}, filter_rows(wanted), current=True)
    rows = (
        matching_projects(tables, wanted)
        .select(
            "pid", "agency_project_name", "managing_agency", "sponsor_agency", "borough",
            "boroughs", "lifecycle_status", "current_phase", "completion_date",
            "completion_date_type", "period_variance_days",
            direction(F.col("period_variance_days")).alias("direction"),
            "attributed_budget",
        )
        .orderBy(F.asc_nulls_last("completion_date"), "pid")
    )
    return rows if n is None else rows.limit(max(1, int(n)))


def portfolio_summary(tables, wanted: PortfolioFilter = PortfolioFilter(), n: int | None = None) -> DataFrame:
    """One row over every matching schedule; ``truncated`` tells whether a listing of ``n`` would cut some.

    ``attributed_budget_total`` counts a shared line once per schedule it funds;
    ``line_budget_total`` counts each line once. One row per schedule and one per link meet
    the matching set in a single join, so the set is computed once for both totals. Tables read more than once are derived
    once, with only the columns that the measures and conditions read.
    """
    measures = ("completion_date", "period_variance_days", "attributed_budget")
    own = Counter(latest_project_state=2, pid_links=1, lifetime_budget_variance=1)
    line = ["fms_id", "managing_agency"]
    tables = tables.sharing(own + filter_uses(wanted), {
        "latest_project_state": ("pid", *measures, *filter_columns(wanted)),
        "lifetime_budget_variance": (*line, "latest_budget"),
    })
    members = tables["pid_links"].select("pid", *line, F.lit(False).alias("is_project")).unionByName(
        tables["latest_project_state"].select("pid", F.lit(True).alias("is_project")),
        allowMissingColumns=True,
    )
    matched = matching_projects(tables, wanted).select("pid", *measures)
    kept = join_many_to_one(members, matched, ["pid"])
    of_project = [F.when(F.col("is_project"), F.col(c)).alias(c) for c in ("pid", *measures)]
    once = kept.select(*line, *of_project).distinct()
    budgets = tables["lifetime_budget_variance"].select(*line, "latest_budget")
    return (
        join_many_to_one(once, budgets, line, "left")
        .agg(
            F.count("pid").alias("n_projects"),
            money_sum(F.col("attributed_budget")).alias("attributed_budget_total"),
            F.count("completion_date").alias("n_with_completion_date"),
            F.count_if(F.col("period_variance_days") > 0).alias("n_delayed_this_period"),
            money_sum(F.col("latest_budget")).alias("line_budget_total"),
        )
        .withColumn("truncated", (F.col("n_projects") > max(1, int(n))) if n is not None else F.lit(False))
    )
