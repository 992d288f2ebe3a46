"""Raw table layout: declared columns, all text, and the dataset registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The published column lists, in file order.
RAW_COLUMNS = {
    "raw_project_detail": [
        "reporting_period", "managing_agency", "sponsor_agency", "pid", "fms_id", "total_budget",
        "spend_to_date", "spend_to_date_1", "fms_project_name", "agency_project_name",
        "agency_project_description", "current_phase", "current_phase_start",
        "forecast_current_phase_end", "forecast_completion", "actual_design_start",
        "actual_design_end", "actual_construction", "actual_construction_1",
        "actual_construction_start", "actual_construction_end", "borough", "community_board",
        "budget_line", "ten_year_plan_category", "agency_data_date", "fms_data_date",
    ],
    "raw_budget_fy": [
        "reporting_period", "managing_agency", "fms_id", "fiscal_year",
        "total_budget_city_non_city", "city", "non_city", "spend",
    ],
    "raw_budget_history": [
        "managing_agency", "fms_id", "year_month_reported", "total_budget", "spend_to_date",
        "spend_to_date_1", "budget_variance", "budget_variance_1",
    ],
    "raw_schedule_history": [
        "reporting_period", "managing_agency", "pid", "agency_project_name", "current_phase",
        "completion_date", "completion_date_type", "variance_day",
        "reason_for_forecast_completion_change", "data_date",
    ],
}


@dataclass(frozen=True)
class Dataset:
    dataset_id: str
    title: str
    table: str
    period_column: str


# Published dataset ids and the column holding each one's period.
DATASETS = (
    Dataset("95tx-snak", "Schedule History & Variance", "raw_schedule_history", "reporting_period"),
    Dataset("fb86-vt7u", "Capital Project List Detail", "raw_project_detail", "reporting_period"),
    Dataset("gyhf-rsr3", "Budget & Spend by FY", "raw_budget_fy", "reporting_period"),
    Dataset("qj5n-h5qp", "Budget Spend History & Variance", "raw_budget_history", "year_month_reported"),
)


def raw_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS[table]])
