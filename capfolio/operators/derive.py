"""Normalized tables -> analytic tables (funding, latest state, lifetime, rollup, owners)."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capfolio.functions.aggregates import value_at_latest
from capfolio.functions.casts import money_sum
from capfolio.functions.joins import join_many_to_one
from capfolio.functions.periods import in_cadence
from capfolio.functions.text import owner_atoms

# Fixed value: variances beyond a century are data errors and stay out of sums and ranks.
MAX_VARIANCE_DAYS = 36500

STATE_COLUMNS = (
    "agency_project_name", "lifecycle_status", "current_phase", "phase_norm",
    "managing_agency", "sponsor_agency", "self_managed", "borough", "boroughs",
    "completion_date", "completion_date_type", "forecast_completion",
    "actual_construction_end", "variance_day", "direction", "reason_for_delay",
)
# The raw detail columns behind a column of the latest state; the other ones come from keys, variance or links.
STATE_INPUT = {
    "agency_project_name": ("agency_project_name",),
    "lifecycle_status": ("current_phase", "actual_construction_end"),
    "current_phase": ("current_phase",),
    "phase_norm": ("current_phase",),
    "managing_agency": ("managing_agency",),
    "sponsor_agency": ("sponsor_agency",),
    "self_managed": ("managing_agency", "sponsor_agency"),
    "borough": ("borough",),
    "boroughs": ("borough",),
    "forecast_completion": ("forecast_completion",),
    "actual_construction_end": ("actual_construction_end",),
}
FUNDING_COLUMNS = ("n_linked_budgets", "attributed_budget")
# The measures of the last snapshot, their raw columns, and the lifetime columns made of each.
LAST_MEASURES = {
    "total_budget": ("total_budget", ("latest_budget", "cumulative_budget_change")),
    "spend_to_date": ("spend_to_date", ("spend_to_date",)),
    "spend_pct": ("spend_to_date_1", ("spend_pct",)),
    "budget_variance": ("budget_variance", ("budget_variance", "over_budget")),
}
ADOPTED_COLUMNS = ("original_budget", "original_budget_source", "cumulative_budget_change")
LOCATION_INPUT = ("reporting_period", "fms_id", "managing_agency", "borough", "community_board")


def within_variance_guard(days, most: int = MAX_VARIANCE_DAYS):
    return days.between(-most, most)


def variances_left_out(history: DataFrame, most: int = MAX_VARIANCE_DAYS) -> DataFrame:
    """Per period, how many variances the guard keeps out of sums and ranks."""
    outside = ~within_variance_guard(F.col("variance_day"), most)
    return history.groupBy("reporting_period").agg(
        F.count("variance_day").alias("n_variances"), F.count_if(outside).alias("n_left_out")
    )


def pid_links(edges: DataFrame) -> DataFrame:
    """Current links: each schedule's edges at its own latest link period.

    Kept as rows. A list per schedule would gather a hot schedule's lines in one task. ``edges`` may repeat; repeats
    are dropped after all older periods are, which are most of the rows.
    """
    latest = edges.groupBy("pid").agg(F.max("reporting_period").alias("reporting_period"))
    return join_many_to_one(edges, latest, ["pid", "reporting_period"]).select(
        "pid", "reporting_period", "fms_id", "managing_agency", "commitments"
    ).distinct()


def pid_funding(links: DataFrame) -> DataFrame:
    """Number and sum of current commitments per schedule."""
    return links.groupBy("pid").agg(
        F.count("*").alias("n_linked_budgets"),
        money_sum(F.col("commitments")).alias("attributed_budget"),
    )


def latest_snapshot(history: DataFrame) -> DataFrame:
    """The newest row per schedule. The input grain (pid, period) makes it unique."""
    body = [c for c in history.columns if c not in ("pid", "reporting_period")]
    newest = F.max(F.struct("reporting_period", *body))
    return history.groupBy("pid").agg(newest.alias("s")).select("pid", "s.*")


def latest_project_state(newest: DataFrame, funding: DataFrame) -> DataFrame:
    """The newest row of each schedule, which ``newest`` holds alone, with its funding."""
    return newest.join(funding, "pid", "left").select(
        "pid", "agency_project_name", "reporting_period", "lifecycle_status",
        "current_phase", "phase_norm", "managing_agency", "sponsor_agency", "self_managed",
        "borough", "boroughs", "completion_date", "completion_date_type",
        "forecast_completion", "actual_construction_end",
        F.col("variance_day").alias("period_variance_days"),
        "direction", "reason_for_delay",
        F.coalesce("n_linked_budgets", F.lit(0)).alias("n_linked_budgets"),
        F.coalesce("attributed_budget", F.lit(0.0)).alias("attributed_budget"),
    )


def fms_location(detail: DataFrame) -> DataFrame:
    """Place of each (line, agency) over all history: its newest in-cadence row, as a pair."""
    newest = F.max(F.struct("reporting_period", "borough", "community_board"))
    return (
        detail.where(F.col("fms_id").isNotNull() & in_cadence(F.col("reporting_period")))
        .groupBy("fms_id", "managing_agency")
        .agg(newest.alias("place"))
        .select("fms_id", "managing_agency", "place.borough", "place.community_board")
    )


def cumulative_schedule_variance(history: DataFrame) -> DataFrame:
    """Summed variance per schedule, with the variance and forecast last reported."""
    days, period = F.col("variance_day"), F.col("reporting_period")
    return (
        history.where(days.isNotNull())
        .groupBy("pid")
        .agg(
            F.sum(F.when(within_variance_guard(days), days)).alias("cumulative_variance_days"),
            value_at_latest(days, period).alias("period_variance_days"),
            value_at_latest(F.col("forecast_completion"), period).alias(
                "latest_forecast_completion"
            ),
        )
    )


def last_measures(columns: Collection[str] | None = None) -> list[str]:
    """The measures of the last snapshot that the given lifetime columns need, or all."""
    return [m for m, (_, made) in LAST_MEASURES.items() if columns is None or set(made) & set(columns)]


def lifetime_budget_variance(
    snapshots: DataFrame, adopted: DataFrame, columns: Collection[str] | None = None
) -> DataFrame:
    """First and last snapshot per (line, agency) against the adopted budget.

    Whole snapshot rows are compared by period, so a NULL measure in the first or last
    snapshot stays NULL instead of falling back to another period's value. A snapshot has a period of its own within
    its line, so the period decides alone, and ``columns`` may leave out measures: only those columns are returned.
    """
    first = F.min(F.struct("reporting_period", "total_budget"))
    held = last_measures(columns)
    last = F.max(F.struct("reporting_period", *held))
    ends = snapshots.groupBy("fms_id", "managing_agency").agg(first.alias("a"), last.alias("z"))
    original = F.coalesce("original_budget", F.col("a.total_budget"))
    has_adopted = F.col("original_budget").isNotNull()
    measures = {
        "original_budget": original,
        "original_budget_source": F.when(has_adopted, "adopted").otherwise("first_snapshot"),
        "first_snapshot_budget": F.col("a.total_budget"),
        "latest_budget": F.col("z.total_budget"),
        "cumulative_budget_change": F.col("z.total_budget") - original,
        "spend_to_date": F.col("z.spend_to_date"),
        "spend_pct": F.col("z.spend_pct"),
        "budget_variance": F.col("z.budget_variance"),
        "over_budget": F.coalesce(F.col("z.budget_variance") > 0, F.lit(False)),
    }
    return ends.join(
        adopted.select("fms_id", "managing_agency", "original_budget"),
        ["fms_id", "managing_agency"],
        "left",
    ).select(
        "fms_id", "managing_agency",
        *[made.alias(name) for name, made in measures.items() if columns is None or name in columns],
    )


def agency_rollup_by_period(history: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Schedule counts beside budget sums per (agency, period).

    Snapshots hold one row per (line, agency, period), so they add up without another
    distinct. NULL agencies on the two sides stay apart, as in any equi-join.
    """
    keys = ["managing_agency", "reporting_period"]
    schedules = history.groupBy(*keys).agg(
        F.count("*").alias("pid_count"),
        F.count_if(F.col("lifecycle_status") == "completed").alias("completed_count"),
        F.count_if(F.col("variance_day") > 0).alias("delayed_count"),
    )
    budgets = snapshots.groupBy(*keys).agg(
        money_sum(F.col("total_budget")).alias("total_budget"),
        money_sum(F.col("spend_to_date")).alias("total_spend"),
    )
    counts = ("pid_count", "completed_count", "delayed_count")
    return schedules.join(budgets, keys, "full_outer").select(
        *keys,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        "total_budget", "total_spend",
    )


def fms_sponsor(state: DataFrame, links: DataFrame) -> DataFrame:
    """Owner of each line: the single sponsors of the schedules it currently funds."""
    owners = state.select("pid", F.explode(owner_atoms(F.col("sponsor_agency"))).alias("sponsor_agency"))
    owned = join_many_to_one(
        links.select("pid", "fms_id"), owners.where(F.col("sponsor_agency") != ""), ["pid"]
    )
    return owned.select("fms_id", "sponsor_agency").distinct()
