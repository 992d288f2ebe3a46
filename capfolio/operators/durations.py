"""Days between actual milestones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capfolio.functions.medians import histogram, with_medians
from capfolio.operators.derive import latest_snapshot
from capfolio.operators.scope import one_of

MILESTONES = ("actual_design_start", "actual_construction_end")
DURATION_GROUPS = ("managing_agency", "borough", "lifecycle_status")


def project_durations(
    tables,
    from_milestone: str = "actual_design_start",
    to_milestone: str = "actual_construction_end",
    group_by: str | None = None,
) -> DataFrame:
    """Statistics over schedules whose newest snapshot has both dates.

    ``excluded_missing_dates`` counts the schedules left out, in all or per group; groups without any duration are absent.
    Everything comes from one count of schedules per group and duration.
    """
    one_of("from_milestone", from_milestone, MILESTONES)
    one_of("to_milestone", to_milestone, MILESTONES)
    if group_by is not None:
        one_of("group_by", group_by, DURATION_GROUPS)
    keys = [group_by] if group_by else []
    used = list(dict.fromkeys(["pid", "reporting_period", *keys, from_milestone, to_milestone]))
    days = latest_snapshot(tables["schedule_history"].select(*used)).withColumn(
        "days", F.datediff(to_milestone, from_milestone)
    )
    counts = histogram(days, keys, "days")
    sums = counts.groupBy(*keys).agg(
        F.sum(F.when(F.col("days").isNotNull(), F.col("n"))).alias("n_projects"),
        F.sum(F.col("days") * F.col("n")).alias("all_days"),
        F.min("days").cast("int").alias("min_days"),
        F.max("days").cast("int").alias("max_days"),
        F.sum(F.when(F.col("days").isNull(), F.col("n"))).alias("excluded_missing_dates"),
    )
    found = with_medians(sums, counts, keys, "days").select(
        *keys,
        F.coalesce("n_projects", F.lit(0)).alias("n_projects"),
        (F.col("all_days") / F.col("n_projects")).alias("mean_days"),
        F.col("median").alias("median_days"), "min_days", "max_days",
        F.coalesce("excluded_missing_dates", F.lit(0)).alias("excluded_missing_dates"),
    )
    if group_by is None:
        return found
    return found.where("n_projects > 0").orderBy(F.desc("n_projects"), F.asc_nulls_last(group_by))
