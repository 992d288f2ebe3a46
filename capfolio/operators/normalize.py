"""Raw text tables -> typed, in-cadence tables at a stated grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capfolio.functions.aggregates import value_at_earliest
from capfolio.functions.casts import to_date, to_double, to_int, to_long
from capfolio.functions.joins import join_many_to_one
from capfolio.functions.periods import in_cadence
from capfolio.functions.phases import (
    CANCELLED_RANK,
    COMPLETED_RANK,
    is_reason,
    phase_key,
    phase_label,
    phase_rank,
)
from capfolio.functions.signs import direction

CITYWIDE = "Citywide"
SEVERAL = "Multiple"

EDGE_INPUT = ("reporting_period", "managing_agency", "pid", "fms_id", "total_budget")
SPINE_INPUT = (
    "reporting_period", "managing_agency", "sponsor_agency", "pid", "agency_project_name",
    "agency_project_description", "current_phase", "forecast_completion",
    "actual_design_start", "actual_construction_end", "borough", "community_board",
)
VARIANCE_INPUT = (
    "reporting_period", "pid", "variance_day", "completion_date", "completion_date_type",
    "reason_for_forecast_completion_change",
)
SNAPSHOT_INPUT = (
    "managing_agency", "fms_id", "year_month_reported", "total_budget", "spend_to_date",
    "spend_to_date_1", "budget_variance", "budget_variance_1",
)
ADOPTED_INPUT = ("managing_agency", "fms_id", "year_month_reported", "total_budget", "spend_to_date")
FISCAL_INPUT = (
    "reporting_period", "managing_agency", "fms_id", "fiscal_year", "city", "non_city", "spend",
)


def edge_rows(detail: DataFrame) -> DataFrame:
    """(period, pid, line, agency, commitment) of each detail row, repeats included; pid and line are non-NULL."""
    return detail.where(
        in_cadence(F.col("reporting_period"))
        & F.col("pid").isNotNull()
        & F.col("fms_id").isNotNull()
    ).select(
        "reporting_period", "pid", "fms_id", "managing_agency",
        to_double(F.col("total_budget")).alias("commitments"),
    )


def link_edges(detail: DataFrame) -> DataFrame:
    """Distinct (period, pid, line, agency, commitment); pid and line are non-NULL."""
    return edge_rows(detail).distinct()


def schedule_budget_link(edges: DataFrame) -> DataFrame:
    """Edges with the fan-out seen from either end.

    The counts are map-side-combined aggregates joined back, not windows: a window would
    put all edges of one hot schedule or line into one task. All three branches read the
    same exchange of the distinct edges.
    """
    schedule = ("reporting_period", "pid")
    line = ("reporting_period", "fms_id", "managing_agency")
    per_pid = edges.groupBy(*schedule).agg(F.count("*").alias("n_budgets_for_pid"))
    per_line = edges.groupBy(*line).agg(F.count("*").alias("n_pids_for_budget"))
    counted = join_many_to_one(edges, per_pid, schedule)
    counted = join_many_to_one(counted, per_line, line, null_matches=True)
    return counted.select(
        "reporting_period", "pid", "fms_id", "managing_agency", "commitments",
        "n_budgets_for_pid", "n_pids_for_budget",
    )


def schedule_spine(detail: DataFrame) -> DataFrame:
    """One row per (pid, period) from the detail rows.

    The scalar borough needs only the least and greatest specific borough. The two set
    columns hold place names, a fixed geographic vocabulary; they combine on the map side
    and are dropped from the plan unless somebody reads them.
    """
    borough, phase = F.col("borough"), F.col("current_phase")
    specific = F.when(borough != CITYWIDE, borough)
    low, high = F.min(specific), F.max(specific)
    return (
        detail.where(F.col("pid").isNotNull() & in_cadence(F.col("reporting_period")))
        .groupBy("pid", "reporting_period")
        .agg(
            F.min("managing_agency").alias("managing_agency"),
            F.min("sponsor_agency").alias("sponsor_agency"),
            F.min("agency_project_name").alias("agency_project_name"),
            F.min("agency_project_description").alias("agency_project_description"),
            F.when(low < high, SEVERAL)
            .otherwise(F.coalesce(low, F.when(F.count(borough) > 0, CITYWIDE)))
            .alias("borough"),
            F.sort_array(F.collect_set(borough)).alias("boroughs"),
            F.sort_array(F.collect_set("community_board")).alias("community_boards"),
            F.coalesce(F.min(F.when(~is_reason(phase), phase)), F.min(phase)).alias("raw_phase"),
            F.max(phase_rank(phase)).alias("phase_score"),
            F.max(to_date(F.col("actual_construction_end"))).alias("actual_construction_end"),
            F.max(to_date(F.col("actual_design_start"))).alias("actual_design_start"),
            F.max(to_date(F.col("forecast_completion"))).alias("forecast_completion"),
        )
    )


def newest_reports(detail: DataFrame) -> DataFrame:
    """The detail rows of each schedule's newest period.

    Taken before ``schedule_spine``, whose texts and sets of places are then put together for one period of a schedule
    instead of all; the newest periods need two columns.
    """
    newest = (
        detail.where(F.col("pid").isNotNull() & in_cadence(F.col("reporting_period")))
        .groupBy("pid")
        .agg(F.max("reporting_period").alias("reporting_period"))
    )
    return join_many_to_one(detail, newest, ["pid", "reporting_period"], "left_semi")


def current_details(detail: DataFrame) -> DataFrame:
    """The detail rows of each schedule's newest period, and those with a line of its newest period that has one.

    ``newest_reports`` and the current links are the same of these rows as of all.
    """
    period = F.col("reporting_period")
    rows = detail.where(F.col("pid").isNotNull() & in_cadence(period))
    newest = rows.groupBy("pid").agg(
        F.max(period).alias("newest"), F.max(F.when(F.col("fms_id").isNotNull(), period)).alias("newest_linked")
    )
    linked = F.col("fms_id").isNotNull() & (period == F.col("newest_linked"))
    found = join_many_to_one(rows, newest, ["pid"]).where((period == F.col("newest")) | linked)
    return found.select(*detail.columns)


def schedule_variance(history: DataFrame, repeats: bool = True) -> DataFrame:
    """Reported variance per (pid, period); the least value where a key repeats, which ``repeats`` rules out."""
    rows = history.where(F.col("pid").isNotNull() & in_cadence(F.col("reporting_period")))
    measures = {
        "variance_day": to_long(F.col("variance_day")),
        "completion_date": F.col("completion_date"),
        "completion_date_type": F.col("completion_date_type"),
        "reason_for_delay": F.col("reason_for_forecast_completion_change"),
    }
    key = ("pid", "reporting_period")
    if not repeats:
        return rows.select(*key, *[value.alias(name) for name, value in measures.items()])
    return rows.groupBy(*key).agg(*[F.min(value).alias(name) for name, value in measures.items()])


def schedule_history(spine: DataFrame, variance: DataFrame) -> DataFrame:
    """Spine with its variance. Both sides are already hashed on the join key."""
    score = F.col("phase_score")
    status = (
        F.when(
            F.col("actual_construction_end").isNotNull() | (score == COMPLETED_RANK), "completed"
        )
        .when(score == CANCELLED_RANK, "cancelled")
        .otherwise("in_progress")
    )
    return spine.join(variance, ["pid", "reporting_period"], "left").select(
        "pid", "reporting_period", "managing_agency", "sponsor_agency",
        "agency_project_name", "agency_project_description",
        "borough", "boroughs", "community_boards",
        phase_label(F.col("raw_phase")).alias("current_phase"),
        phase_key(F.col("raw_phase")).alias("phase_norm"),
        "actual_construction_end", "actual_design_start", "forecast_completion",
        "variance_day",
        direction(F.col("variance_day")).alias("direction"),
        "completion_date", "completion_date_type", "reason_for_delay",
        status.alias("lifecycle_status"),
        (F.col("managing_agency") == F.col("sponsor_agency")).alias("self_managed"),
    )


def budget_history(history: DataFrame, repeats: bool = True) -> DataFrame:
    """Budget snapshots, one per (line, agency, period); the greatest value on a repeat, which ``repeats`` rules out.

    A row without spend is an adopted-budget record, not a snapshot.
    """
    measures = {
        "total_budget": "total_budget",
        "spend_to_date": "spend_to_date",
        "spend_pct": "spend_to_date_1",
        "budget_variance": "budget_variance",
        "budget_variance_pct": "budget_variance_1",
    }
    rows = history.where(in_cadence(F.col("year_month_reported")) & F.col("spend_to_date").isNotNull())
    key = ("fms_id", "managing_agency", F.col("year_month_reported").alias("reporting_period"))
    if not repeats:
        return rows.select(*key, *[to_double(F.col(raw)).alias(name) for name, raw in measures.items()])
    return rows.groupBy(*key).agg(*[F.max(to_double(F.col(raw))).alias(name) for name, raw in measures.items()])


def original_budget(history: DataFrame) -> DataFrame:
    """The first adopted budget per (line, agency), from any month."""
    period = F.col("year_month_reported")
    return (
        history.where(F.col("spend_to_date").isNull())
        .groupBy("fms_id", "managing_agency")
        .agg(
            F.min(period).alias("recorded_period"),
            value_at_earliest(to_double(F.col("total_budget")), period).alias("original_budget"),
        )
    )


def project_budget_fy(fiscal: DataFrame) -> DataFrame:
    """Fiscal-year budgets, typed; the combined total column is left out."""
    return fiscal.where(in_cadence(F.col("reporting_period"))).select(
        "fms_id", "managing_agency", "reporting_period",
        to_int(F.col("fiscal_year")).alias("fiscal_year"),
        *[to_double(F.col(c)).alias(c) for c in ("city", "non_city", "spend")],
    )
