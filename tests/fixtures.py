"""A small invented town with known answers: its agencies, category rules and raw rows."""

from __future__ import annotations

import pyarrow as pa

from capfolio import Tables
from capfolio.sources.dictionaries import Agency, Category, Taxonomy
from capfolio.sources.raw import FrameSource
from capfolio.sources.schemas import RAW_COLUMNS

BUILDER = Agency("builder", "Bureau of Works", ("BLD",), "BLD", True, "managing")
HARBOUR = Agency("harbour", "Harbour Authority", ("HRB", "Harbour Authority"), "HRB", True)
FOREST = Agency("forest", "Forestry Office", ("FOR",), "FOR", True)
TRAM = Agency("tram", "Tramway Board", ("TRM",), "TRM", True)
CARE = Agency("care", "Clinics & Care", ("C+C", "CLN", "Clinics & Care"), "CLN")
ASSEMBLY = Agency("assembly", "Town Assembly", ("Town Assembly",))
AGENCIES = (BUILDER, HARBOUR, FOREST, TRAM, CARE, ASSEMBLY)

RULES = Taxonomy(
    (
        Category("Reading", prefixes=("RD",), ever_managed_by=("RDS",), sponsors=("RDS",)),
        Category("Crossings", keywords=("viaduct",), prefixes=("VX",)),
        Category("Greens", keywords=("meadow",), sponsors=("FOR",)),
        Category("Pipes", keywords=("culvert", "drain"), sponsors=("PIP",)),
        Category("Stages", ever_managed_by=("ART",), sponsors=("ART",)),
        Category("Premises", keywords=("premises", "repair"), generic=True),
    )
)
OTHER = RULES.other_label
NOW, BEFORE, FIRST = "202201", "202109", "202105"


def raw_frame(spark, table, rows):
    columns = RAW_COLUMNS[table]
    full = [{c: r.get(c) for c in columns} for r in rows]
    layout = pa.schema([(c, pa.string()) for c in columns])
    return spark.createDataFrame(pa.Table.from_pylist(full, schema=layout))


def detail(period, managing, sponsor, pid, line, amount="7", phase="Design", **more):
    return dict(
        reporting_period=period, managing_agency=managing, sponsor_agency=sponsor, pid=pid, fms_id=line,
        total_budget=amount, current_phase=phase, **more,
    )


def budget(holder, line, period, total, spend="0", move="0"):
    return dict(
        managing_agency=holder, fms_id=line, year_month_reported=period, total_budget=total, spend_to_date=spend,
        budget_variance=move,
    )


def schedule(period, pid, days, **more):
    return dict(reporting_period=period, managing_agency="BLD", pid=pid, variance_day=days, **more)


TOWN_DETAIL = [
    detail(NOW, "BLD", "BLD", "quay", "L1", "120", borough="North", agency_project_name="Quay wall"),
    detail(NOW, "BLD", "BLD", "quay", "L2", "35", borough="North", agency_project_name="Quay wall"),
    detail(NOW, "BLD", "BLD", "quay", "L5", "11", borough="North", agency_project_name="Quay wall"),
    detail(NOW, "BLD", "FOR", "barn", "L3", "410", "(Completed)", borough="East", agency_project_name="Seed_barn"),
    detail(NOW, "ZOO", None, None, "L4", "75", "(Pending)", borough="West"),
    detail("202202", "BLD", "BLD", "quay", "L1", "9000", borough="North", agency_project_name="Quay wall"),
]
TOWN_SCHEDULE = [schedule(NOW, "quay", "17", completion_date="2023-03-31", completion_date_type="Forecast")]
TOWN_BUDGET = [
    budget("BLD", "L1", NOW, "120", "30"),
    budget("BLD", "L1", BEFORE, "95", "12"),
    budget("BLD", "L2", NOW, "35", "4"),
    budget("BLD", "L3", NOW, "410", "60"),
]
# A line with an adopted budget and later snapshots.
GROWN = [
    budget("FOR", "GR", "201808", "640", None, None),
    budget("FOR", "GR", BEFORE, "700", "3", "0"),
    budget("FOR", "GR", NOW, "815", "5", "115"),
]
# One agency as builder, as owner, and as one of two owners.
OWNED_DETAIL = [
    detail(NOW, "HRB", "HRB", "pier", "P1", "64"),
    detail(NOW, "BLD", "HRB", "lock", "P2", "2100"),
    detail(NOW, "BLD", "TRM, FOR", "stop", "P3", "330"),
]
OWNED_BUDGET = [budget("HRB", "P1", NOW, "64"), budget("BLD", "P2", NOW, "2100"), budget("BLD", "P3", NOW, "330")]
# Lines shared by schedules, and a schedule in two places.
SHARED_DETAIL = [
    detail(NOW, "FOR", "FOR", "hall", "RD7", "81", borough="North"),
    detail(NOW, "FOR", "FOR", "hall", "VX2", "19", borough="North"),
    detail(NOW, "FOR", "FOR", "annex", "RD8", "260", borough="West"),
    detail(NOW, "FOR", "FOR", "depot", "RD8", "260", borough="West"),
    detail(NOW, "FOR", "FOR", "path", "W1", "12", borough="South", community_board="South 3"),
    detail(NOW, "FOR", "FOR", "path", "W2", "14", borough="East"),
]
SHARED_BUDGET = [
    budget("FOR", "RD7", NOW, "81", "9"), budget("FOR", "VX2", NOW, "19", "2"), budget("FOR", "RD8", NOW, "260", "44"),
    budget("FOR", "W1", NOW, "12", "1"), budget("FOR", "W2", NOW, "14", "1"),
]


def tables(spark, details=(), budgets=(), schedules=(), fiscal=(), agencies=AGENCIES, taxonomy=RULES):
    source = FrameSource(
        {
            "raw_project_detail": raw_frame(spark, "raw_project_detail", details),
            "raw_budget_history": raw_frame(spark, "raw_budget_history", budgets),
            "raw_schedule_history": raw_frame(spark, "raw_schedule_history", schedules),
            "raw_budget_fy": raw_frame(spark, "raw_budget_fy", fiscal),
        }
    )
    return Tables(spark, source, agencies, taxonomy)


def town(spark, details=(), budgets=(), schedules=(), **more):
    return tables(
        spark, [*TOWN_DETAIL, *details], [*TOWN_BUDGET, *budgets], [*TOWN_SCHEDULE, *schedules], **more
    )


def column(frame, name):
    return {r[name] for r in frame.collect()}


def keyed(frame, *keys):
    return {(r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys)): r for r in frame.collect()}
