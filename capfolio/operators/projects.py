"""Finding and opening single projects; every operator also serves all of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capfolio.functions.joins import join_many_to_one
from capfolio.functions.signs import direction, link_caveat
from capfolio.functions.text import contains_text, same_text

BUDGET_LOOKUP_INPUT = ("fms_id", "managing_agency", "fms_project_name")


def find_schedules(tables, query: str, limit: int | None = None) -> DataFrame:
    """Schedules whose id equals, or whose name or description contains, the text.

    Each is shown by its newest matching snapshot, with the field that matched there. All matches are returned
    unless the caller gives a ``limit``.
    """
    by_id = same_text(F.col("pid"), query)
    by_name = contains_text(F.col("agency_project_name"), query)
    by_description = contains_text(F.col("agency_project_description"), query)
    field = (
        F.when(by_id, "pid")
        .when(by_name, "agency_project_name")
        .otherwise("agency_project_description")
    )
    newest = F.max(
        F.struct(
            "reporting_period", "agency_project_name", "managing_agency", "sponsor_agency",
            "lifecycle_status", field.alias("matched_field"),
        )
    )
    found = (
        tables["schedule_history"]
        .where(by_id | by_name | by_description)
        .groupBy("pid")
        .agg(newest.alias("m"))
        .select("pid", "m.*")
        .drop("reporting_period")
        .orderBy("pid")
    )
    return found if limit is None else found.limit(limit)


def find_budget_lines(tables, query: str, limit: int | None = None) -> DataFrame:
    """Distinct detail lines whose id equals, or whose name contains, the text; all, or ``limit``."""
    by_id = same_text(F.col("fms_id"), query)
    by_name = contains_text(F.col("fms_project_name"), query)
    ids = ("fms_id", "managing_agency", "fms_project_name")
    found = (
        tables.raw("raw_project_detail", BUDGET_LOOKUP_INPUT)
        .where(by_id | by_name)
        .select(*ids, F.when(by_id, "fms_id").otherwise("fms_project_name").alias("matched_field"))
        .distinct()
        .orderBy(*[F.asc_nulls_last(c) for c in ids])
    )
    return found if limit is None else found.limit(limit)


def schedule_links(tables, pid: str | None = None) -> DataFrame:
    """Budget lines of a schedule (or of each) at its own newest link period."""
    links = tables["pid_links"]
    if pid is not None:
        links = links.where(F.col("pid") == pid)
    return links.select("pid", "fms_id", "managing_agency").distinct()


def schedule_detail(tables, pid: str | None = None) -> DataFrame:
    """Latest state of a schedule (or of each) with its number of linked lines."""
    state = tables["latest_project_state"]
    if pid is not None:
        state = state.where(F.col("pid") == pid)
    linked = schedule_links(tables, pid).groupBy("pid").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return state.join(linked, "pid", "left").select(
        "pid", F.col("managing_agency").alias("agency"), "sponsor_agency", "borough", "boroughs",
        F.col("current_phase").alias("phase"), "lifecycle_status", "period_variance_days",
        direction(F.col("period_variance_days")).alias("direction"),
        "reason_for_delay", "forecast_completion", "attributed_budget",
        n.alias("n_linked"), link_caveat(n, "schedule").alias("caveat"),
    )


def _line_key(by_agency: bool) -> list[str]:
    return ["line_key", "managing_agency"] if by_agency else ["line_key"]


def budget_links(
    tables, fms_id: str | None = None, managing_agency: str | None = None, by_agency: bool = False
) -> DataFrame:
    """Schedules of a line (or of each) at the line's newest link period.

    Ids match in any case. Without an agency the newest period is taken over all holders
    of the line; with one (or ``by_agency``) over that holder's links alone.
    """
    edges = tables["link_edges"].withColumn("line_key", F.lower("fms_id"))
    if fms_id is not None:
        edges = edges.where(same_text(F.col("fms_id"), fms_id))
    if managing_agency is not None:
        edges = edges.where(F.col("managing_agency") == managing_agency)
    key = _line_key(by_agency)
    newest = edges.groupBy(*key).agg(F.max("reporting_period").alias("reporting_period"))
    current = join_many_to_one(edges, newest, [*key, "reporting_period"])
    return current.select("line_key", "pid", "managing_agency").distinct()


def budget_detail(
    tables, fms_id: str | None = None, managing_agency: str | None = None, by_agency: bool = False
) -> DataFrame:
    """Lifetime row(s) of a line (or of each) with its number of linked schedules."""
    lines = tables["lifetime_budget_variance"].withColumn("line_key", F.lower("fms_id"))
    if fms_id is not None:
        lines = lines.where(same_text(F.col("fms_id"), fms_id))
    if managing_agency is not None:
        lines = lines.where(F.col("managing_agency") == managing_agency)
    key = _line_key(by_agency)
    linked = (
        budget_links(tables, fms_id, managing_agency, by_agency)
        .groupBy(*key)
        .agg(F.count("*").alias("n"))
    )
    n = F.coalesce("n", F.lit(0))
    return (
        lines.join(linked, key, "left")
        .withColumn("n_linked", n)
        .withColumn("caveat", link_caveat(F.col("n_linked"), "budget"))
        .drop("line_key", "n")
        .select(*tables["lifetime_budget_variance"].columns, "n_linked", "caveat")
    )
