"""Registered queries: a DataFrame function and, beside it, the SQL that must agree.

Array columns are joined into text so that both engines show them alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capfolio.functions.periods import latest_full_period
from capfolio.operators import breakdowns, changes, durations, lookup, portfolio, projects, ranking
from capfolio.operators import reports
from capfolio.operators.dimensions import period_counts
from capfolio.operators.portfolio import PortfolioFilter
from capfolio.operators.scope import resolve_scope
from capfolio.plans.oracle import CADENCE, _direction, _money, statement
from capfolio.plans.tables import Tables
from capfolio.sources.schemas import DATASETS
from capfolio.sources.star import star_tables

FROM, TO = "200105", "200109"
SCHEDULE_NOW = "(SELECT max(reporting_period) FROM schedule_history)"
BUDGET_NOW = "(SELECT max(reporting_period) FROM budget_history)"


@dataclass(frozen=True)
class Query:
    plan: Callable[[Tables], DataFrame]
    sql: str | None = None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.plan(star_tables(spark, folder))


QUERIES: dict[str, Query] = {}


def add(name: str, plan: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = Query(plan, statement(sql) if sql else None)


def joined(frame: DataFrame, *arrays: str) -> DataFrame:
    return frame.withColumns({a: F.array_join(a, "|") for a in arrays})


def rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c in columns})


# -- derived tables -----------------------------------------------------------------

add("n1_link_cardinality", lambda t: t["schedule_budget_link"], "SELECT * FROM schedule_budget_link")
add(
    "n2_schedule_history",
    lambda t: joined(t["schedule_history"], "boroughs", "community_boards"),
    """SELECT * REPLACE (array_to_string(boroughs, '|') AS boroughs,
           array_to_string(community_boards, '|') AS community_boards) FROM schedule_history""",
)
add(
    "n2_phase_score",
    lambda t: t["schedule_spine"].select("pid", "reporting_period", "raw_phase", "phase_score"),
    "SELECT pid, reporting_period, raw_phase, phase_score FROM spine",
)
add(
    "n2_borough_derive",
    lambda t: t["schedule_history"].groupBy("borough", F.size("boroughs").alias("n_boroughs")).agg(
        F.count("*").alias("n")
    ),
    "SELECT borough, CAST(len(boroughs) AS INTEGER) AS n_boroughs, count(*) AS n FROM schedule_history GROUP BY ALL",
)
add("n3_budget_history", lambda t: t["budget_history"], "SELECT * FROM budget_history")
add("n4_original_budget", lambda t: t["original_budget"], "SELECT * FROM original_budget")
add(
    "n5_budget_fy",
    lambda t: t["project_budget_fy"],
    f"""SELECT fms_id, managing_agency, reporting_period, CAST(fiscal_year AS INTEGER) AS fiscal_year,
            CAST(city AS DOUBLE) AS city, CAST(non_city AS DOUBLE) AS non_city, CAST(spend AS DOUBLE) AS spend
        FROM raw_budget_fy WHERE right(reporting_period, 2) IN {CADENCE}""",
)
add("a1_pid_funding", lambda t: t["pid_funding"], "SELECT * FROM pid_funding")
add("a1_pid_links", lambda t: t["pid_links"], "SELECT * FROM pid_links")
add(
    "a2_latest_state",
    lambda t: joined(t["latest_project_state"], "boroughs"),
    "SELECT * REPLACE (array_to_string(boroughs, '|') AS boroughs) FROM latest_project_state",
)
add("a3_fms_location", lambda t: t["fms_location"], "SELECT * FROM fms_location")
add(
    "a4_cum_variance",
    lambda t: t["cumulative_schedule_variance"],
    "SELECT * FROM cumulative_schedule_variance",
)
add(
    "a5_lifetime_budget",
    lambda t: t["lifetime_budget_variance"],
    "SELECT * FROM lifetime_budget_variance",
)
add("a6_agency_rollup", lambda t: t["agency_rollup_by_period"], "SELECT * FROM agency_rollup")
add("a7_fms_sponsor", lambda t: t["fms_sponsor"], "SELECT * FROM fms_sponsor")
add("cat_dim", lambda t: t["category_dim"], "SELECT * FROM category_dim")
add("agency_dim", lambda t: joined(t["agency_dim"], "aliases"), "SELECT * FROM agency_dim")


def _all_period_counts(t: Tables) -> DataFrame:
    parts = [
        period_counts(t.raw(d.table, (d.period_column,)), d.period_column).withColumn(
            "dataset_id", F.lit(d.dataset_id)
        )
        for d in DATASETS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


add("meta_periods", _all_period_counts, "SELECT dataset_id, period, n FROM period_rows")
add(
    "per2_current_period",
    lambda t: latest_full_period(
        period_counts(t.raw("raw_budget_history", ("year_month_reported",)), "year_month_reported")
    ),
    """SELECT (SELECT CAST(sum(n) AS BIGINT) FROM period_rows WHERE dataset_id = 'qj5n-h5qp') AS row_count,
           latest_reporting_period FROM full_period WHERE dataset_id = 'qj5n-h5qp'""",
)

# -- agency scope -------------------------------------------------------------------

add(
    "sc2_scope_schedule_sponsor",
    lambda t: resolve_scope(t, "Building").apply(t["latest_project_state"]).select("pid", "sponsor_agency"),
    """SELECT pid, sponsor_agency FROM latest_project_state
       WHERE list_contains(regexp_split_to_array(trim(sponsor_agency), ' *, *'), 'BUILDING')""",
)
add(
    "sc2_scope_schedule_managing",
    lambda t: resolve_scope(t, "europe").apply(t["latest_project_state"]).select("pid", "managing_agency"),
    "SELECT pid, managing_agency FROM latest_project_state WHERE managing_agency IN ('EUROPE', 'Europe')",
)
add(
    "sc2_scope_budget_sponsor",
    lambda t: resolve_scope(t, "BUILDING", entity="budget")
    .apply(t["lifetime_budget_variance"])
    .select("fms_id", "managing_agency", "latest_budget"),
    """SELECT fms_id, managing_agency, latest_budget FROM lifetime_budget_variance v
       WHERE EXISTS (FROM fms_sponsor s WHERE s.fms_id = v.fms_id AND s.sponsor_agency = 'BUILDING')""",
)
add(
    "sc2_scope_budget_managing",
    lambda t: resolve_scope(t, "LEGACY", entity="budget")
    .apply(t["lifetime_budget_variance"])
    .select("fms_id", "managing_agency", "latest_budget"),
    """SELECT fms_id, managing_agency, latest_budget FROM lifetime_budget_variance
       WHERE managing_agency = 'LEGACY'""",
)

# -- look-up ------------------------------------------------------------------------

add(
    "t1_resolve_schedule",
    lambda t: projects.find_schedules(t, "project 12"),
    """SELECT pid, agency_project_name, managing_agency, sponsor_agency, lifecycle_status,
           'agency_project_name' AS matched_field
       FROM newest_history WHERE contains(lower(agency_project_name), 'project 12') ORDER BY pid""",
)
add(
    "t1_resolve_description",
    lambda t: projects.find_schedules(t, "machinery PROGRAM"),
    """SELECT pid, agency_project_name, managing_agency, sponsor_agency, lifecycle_status,
           'agency_project_description' AS matched_field
       FROM newest_history WHERE lower(agency_project_description) LIKE '%machinery program%'
       ORDER BY pid""",
)
add(
    "t1_resolve_budget",
    lambda t: projects.find_budget_lines(t, "bolt"),
    """SELECT DISTINCT fms_id, managing_agency, fms_project_name, 'fms_project_name' AS matched_field
       FROM raw_project_detail WHERE fms_project_name ILIKE '%bolt%'
       ORDER BY fms_id, managing_agency, fms_project_name""",
)
_SCHEDULE_LINKS = "SELECT DISTINCT pid, fms_id, managing_agency FROM pid_links"
add("t2_schedule_links", projects.schedule_links, _SCHEDULE_LINKS)
add(
    "t2_schedule_detail",
    lambda t: joined(projects.schedule_detail(t), "boroughs"),
    f"""SELECT pid, managing_agency AS agency, sponsor_agency, borough,
           array_to_string(boroughs, '|') AS boroughs, current_phase AS phase, lifecycle_status,
           period_variance_days, direction, reason_for_delay, forecast_completion, attributed_budget,
           coalesce(n, 0) AS n_linked,
           CASE coalesce(n, 0) WHEN 0 THEN 'no linked budget lines at the latest link period'
               WHEN 1 THEN '1:1 with its counterpart among the budget lines'
               ELSE 'many-to-many: ' || n || ' linked budget lines; report all of them' END AS caveat
        FROM latest_project_state
        LEFT JOIN (SELECT pid, count(*) AS n FROM ({_SCHEDULE_LINKS}) GROUP BY pid) USING (pid)""",
)
_BUDGET_LINKS = """SELECT DISTINCT lower(fms_id) AS line_key, pid, managing_agency FROM (
        SELECT *, dense_rank() OVER (PARTITION BY lower(fms_id) ORDER BY reporting_period DESC) AS age
        FROM edges) WHERE age = 1"""
add("t3_budget_links", projects.budget_links, _BUDGET_LINKS)
add(
    "t3_budget_detail",
    projects.budget_detail,
    f"""SELECT v.*, coalesce(n, 0) AS n_linked,
           CASE coalesce(n, 0) WHEN 0 THEN 'no linked schedules at the latest link period'
               WHEN 1 THEN '1:1 with its counterpart among the schedules'
               ELSE 'many-to-many: ' || n || ' linked schedules; report all of them' END AS caveat
        FROM lifetime_budget_variance v
        LEFT JOIN (SELECT line_key, count(*) AS n FROM ({_BUDGET_LINKS}) GROUP BY line_key) k
        ON k.line_key = lower(v.fms_id)""",
)
add(
    "t3_budget_links_by_agency",
    lambda t: projects.budget_links(t, by_agency=True),
    """SELECT DISTINCT lower(fms_id) AS line_key, pid, managing_agency FROM (
        SELECT *, dense_rank() OVER (PARTITION BY lower(fms_id), managing_agency
                                     ORDER BY reporting_period DESC) AS age
        FROM edges) WHERE age = 1""",
)

# -- schedule breakdowns ------------------------------------------------------------

for _label, _column in {
    "agency": "managing_agency",
    "borough": "borough",
    "phase": "phase_norm",
    "lifecycle": "lifecycle_status",
}.items():
    add(
        f"t4_breakdown_{_label}",
        lambda t, c=_column: breakdowns.schedule_breakdown(t, c),
        f"""SELECT {_column}, count(*) AS value, count(*) AS n FROM schedule_history
            WHERE reporting_period = {SCHEDULE_NOW} GROUP BY {_column}""",
    )
add(
    "t4_breakdown_sponsor",
    lambda t: breakdowns.schedule_breakdown(t, "sponsor_agency"),
    f"""SELECT owner AS sponsor_agency, count(*) AS value, count(*) AS n FROM (
            SELECT trim(unnest(string_split(sponsor_agency, ','))) AS owner FROM schedule_history
            WHERE reporting_period = {SCHEDULE_NOW}) WHERE owner <> '' GROUP BY owner""",
)
add(
    "t4_breakdown_category",
    lambda t: breakdowns.schedule_breakdown(t, "category", "schedule_variance", "sum"),
    f"""SELECT category, CAST(sum(variance_day) AS BIGINT) AS value, count(*) AS n,
            {_direction('sum(variance_day)')} AS direction
        FROM schedule_history h
        JOIN (SELECT DISTINCT pid, reporting_period, category FROM edges JOIN category_dim USING (fms_id)) k
            USING (pid, reporting_period)
        WHERE h.reporting_period = {SCHEDULE_NOW} GROUP BY category""",
)
for _statistic, _aggregate in {
    "count": "count(variance_day)",
    "mean": "round(avg(variance_day), 6)",
    "median": "median(variance_day)",
    "sum": "CAST(sum(variance_day) AS BIGINT)",
    "min": "min(variance_day)",
    "max": "max(variance_day)",
}.items():
    _signed = "" if _statistic == "count" else f", {_direction(_aggregate)} AS direction"

    def _variance(t: Tables, statistic: str = _statistic) -> DataFrame:
        groups = breakdowns.schedule_breakdown(t, "managing_agency", "schedule_variance", statistic)
        return rounded(groups, "value") if statistic == "mean" else groups

    add(
        f"t4_variance_{_statistic}",
        _variance,
        f"""SELECT managing_agency, {_aggregate} AS value, count(*) AS n{_signed}
            FROM schedule_history WHERE reporting_period = {SCHEDULE_NOW} GROUP BY managing_agency""",
    )
add(
    "t4_breakdown_scoped",
    lambda t: breakdowns.schedule_breakdown(t, "borough", agency="MACHINERY"),
    f"""SELECT borough, count(*) AS value, count(*) AS n FROM schedule_history
        WHERE reporting_period = {SCHEDULE_NOW}
          AND 'MACHINERY' IN (SELECT trim(unnest(string_split(sponsor_agency, ',')))) GROUP BY borough""",
)

# -- changes ------------------------------------------------------------------------

_PAIR = f"""FROM (SELECT * FROM schedule_history WHERE reporting_period = '{TO}') t
    LEFT JOIN (SELECT * FROM schedule_history WHERE reporting_period = '{FROM}') f USING (pid)"""
_OPEN_BEFORE = "coalesce(f.lifecycle_status, 'in_progress') = 'in_progress'"
add(
    "t5_changes_completed",
    lambda t: changes.schedule_changes(t, "completed", FROM, TO, check_data=False),
    f"""SELECT pid, t.managing_agency, t.lifecycle_status {_PAIR}
        WHERE t.lifecycle_status = 'completed' AND {_OPEN_BEFORE}""",
)
add(
    "t5_changes_completed_incl_cancelled",
    lambda t: changes.schedule_changes(
        t, "completed", FROM, TO, include_cancelled=True, check_data=False
    ),
    f"""SELECT pid, t.managing_agency, t.lifecycle_status {_PAIR}
        WHERE t.lifecycle_status <> 'in_progress' AND {_OPEN_BEFORE}""",
)
add(
    "t5_changes_delayed",
    lambda t: changes.schedule_changes(t, "delayed", FROM, TO, check_data=False),
    f"""SELECT pid, t.managing_agency, t.variance_day {_PAIR}
        WHERE t.variance_day > 0 AND coalesce(f.variance_day, 0) <= 0""",
)
add(
    "t5_changes_delayed_managing",
    lambda t: changes.schedule_changes(t, "delayed", FROM, TO, agency="asia", check_data=False),
    f"""SELECT pid, t.managing_agency, t.variance_day {_PAIR}
        WHERE t.variance_day > 0 AND coalesce(f.variance_day, 0) <= 0 AND t.managing_agency = 'ASIA'""",
)
_REASONS = """SELECT reason_for_delay, count(*) AS n FROM schedule_history
    WHERE variance_day > 0 AND reason_for_delay IS NOT NULL"""
add(
    "t6_delay_reasons_current",
    lambda t: breakdowns.delay_reasons(t),
    f"{_REASONS} AND reporting_period = {SCHEDULE_NOW} GROUP BY reason_for_delay",
)
add(
    "t6_delay_reasons_all",
    lambda t: breakdowns.delay_reasons(t, scope="all_history"),
    f"{_REASONS} GROUP BY reason_for_delay",
)

# -- budgets ------------------------------------------------------------------------

add(
    "t7_budget_agency",
    lambda t: breakdowns.budget_breakdown(t),
    f"""SELECT managing_agency, {_money('total_budget')} AS value, count(*) AS n FROM budget_history
        WHERE reporting_period = {BUDGET_NOW} GROUP BY managing_agency""",
)
add(
    "t7_budget_category",
    lambda t: breakdowns.budget_breakdown(t, "category", "spend"),
    f"""SELECT category, {_money('spend_to_date')} AS value, count(*) AS n
        FROM budget_history JOIN category_dim USING (fms_id)
        WHERE reporting_period = {BUDGET_NOW} GROUP BY category""",
)
add(
    "t7_budget_sponsor_scope",
    lambda t: breakdowns.budget_breakdown(t, agency="Household"),
    f"""SELECT managing_agency, {_money('total_budget')} AS value, count(*) AS n FROM budget_history
        WHERE reporting_period = {BUDGET_NOW}
          AND fms_id IN (SELECT fms_id FROM fms_sponsor WHERE sponsor_agency = 'HOUSEHOLD')
        GROUP BY managing_agency""",
)


def _delta_sql(key: str, group: str, metric: str, condition: str = "true") -> str:
    return f"""SELECT *, to_value - from_value AS change_value,
            {_direction('(to_value - from_value)', 'increased', 'decreased')} AS change_direction
        FROM (SELECT {key},
                {_money(f"CASE WHEN reporting_period = '{FROM}' THEN {metric} END")} AS from_value,
                {_money(f"CASE WHEN reporting_period = '{TO}' THEN {metric} END")} AS to_value
              FROM budget_history WHERE reporting_period IN ('{FROM}', '{TO}') AND {condition} {group})"""


add(
    "t8_change_agency",
    lambda t: changes.budget_changes_by(t, "managing_agency", FROM, TO),
    _delta_sql("managing_agency", "GROUP BY managing_agency", "total_budget"),
)
add(
    "t8_change_fms",
    lambda t: changes.budget_changes_by(t, "fms_id", FROM, TO, "spend"),
    _delta_sql("lower(fms_id) AS fms_id", "GROUP BY lower(fms_id)", "spend_to_date"),
)
add(
    "t8_change_sponsor",
    lambda t: changes.budget_change(t, "agency:FURNITURE", FROM, TO),
    _delta_sql(
        f"'agency:FURNITURE' AS target, '{FROM}' AS from_period, '{TO}' AS to_period", "",
        "total_budget", "fms_id IN (SELECT fms_id FROM fms_sponsor WHERE sponsor_agency = 'FURNITURE')",
    ),
)

# -- rankings -----------------------------------------------------------------------

add(
    "t9_rank_schedule",
    lambda t: ranking.rank_projects(t, "schedule", "period_variance_days", 25),
    f"""SELECT pid, managing_agency, attributed_budget, period_variance_days,
            {_direction('period_variance_days')} AS direction
        FROM latest_project_state WHERE abs(period_variance_days) <= 36500
        ORDER BY period_variance_days DESC, pid LIMIT 25""",
)
add(
    "t9_rank_schedule_cumulative",
    lambda t: ranking.rank_projects(
        t, "schedule", "cumulative_variance_days", 25, "bottom", min_total_budget=10000
    ),
    f"""SELECT pid, s.managing_agency, s.attributed_budget, c.cumulative_variance_days,
            {_direction('c.cumulative_variance_days')} AS direction
        FROM latest_project_state s JOIN cumulative_schedule_variance c USING (pid)
        WHERE abs(c.cumulative_variance_days) <= 36500 AND s.attributed_budget >= 10000
        ORDER BY c.cumulative_variance_days, pid LIMIT 25""",
)
add(
    "t9_rank_schedule_category",
    lambda t: ranking.rank_projects(
        t, "schedule", "period_variance_days", 25, category="Fasteners", delayed_only=True
    ),
    f"""SELECT pid, managing_agency, attributed_budget, period_variance_days,
            {_direction('period_variance_days')} AS direction
        FROM latest_project_state
        WHERE period_variance_days BETWEEN 1 AND 36500
          AND pid IN (SELECT pid FROM edges JOIN category_dim USING (fms_id) WHERE category = 'Fasteners')
        ORDER BY period_variance_days DESC, pid LIMIT 25""",
)
add(
    "t9_rank_budget",
    lambda t: ranking.rank_projects(t, "budget", "total_budget", 25, max_total_budget=150000),
    """SELECT fms_id, managing_agency, latest_budget AS total_budget FROM lifetime_budget_variance
       WHERE latest_budget <= 150000 ORDER BY latest_budget DESC, fms_id, managing_agency LIMIT 25""",
)
add(
    "t9_rank_budget_signed",
    lambda t: ranking.rank_projects(
        t, "budget", "cumulative_budget_change", 25, "bottom", category="Ornaments"
    ),
    f"""SELECT fms_id, managing_agency, cumulative_budget_change,
            {_direction('cumulative_budget_change', 'increased', 'decreased')} AS direction
        FROM lifetime_budget_variance WHERE cumulative_budget_change IS NOT NULL
          AND fms_id IN (SELECT fms_id FROM category_dim WHERE category = 'Ornaments')
        ORDER BY cumulative_budget_change, fms_id, managing_agency LIMIT 25""",
)
add(
    "t9_rank_budget_delayed",
    lambda t: ranking.rank_projects(t, "budget", "spend_pct", 25, delayed_only=True),
    """SELECT fms_id, managing_agency, spend_pct FROM lifetime_budget_variance
       WHERE spend_pct IS NOT NULL AND fms_id IN (
           SELECT fms_id FROM edges
           WHERE pid IN (SELECT pid FROM latest_project_state WHERE period_variance_days > 0))
       ORDER BY spend_pct DESC, fms_id, managing_agency LIMIT 25""",
)
add(
    "t9_rank_budget_sponsor",
    lambda t: joined(
        ranking.rank_projects(t, "budget", "budget_variance", 25, agency="automobile"),
        "sponsor_agencies",
    ),
    f"""SELECT fms_id, managing_agency, budget_variance,
            {_direction('budget_variance', 'increased', 'decreased')} AS direction,
            array_to_string(list_sort(owners), '|') AS sponsor_agencies
        FROM lifetime_budget_variance
        JOIN (SELECT fms_id, list(sponsor_agency) AS owners FROM fms_sponsor GROUP BY fms_id) o USING (fms_id)
        WHERE budget_variance IS NOT NULL AND list_contains(owners, 'AUTOMOBILE')
        ORDER BY budget_variance DESC, fms_id, managing_agency LIMIT 25""",
)

# -- durations and portfolio --------------------------------------------------------

_DAYS = """(SELECT *, date_diff('day', actual_design_start, actual_construction_end) AS days
    FROM newest_history)"""
_DAY_STATISTICS = """count(days) AS n_projects, round(avg(days), 6) AS mean_days,
    median(days) AS median_days, CAST(min(days) AS INTEGER) AS min_days,
    CAST(max(days) AS INTEGER) AS max_days"""
add(
    "t10_duration_all",
    lambda t: rounded(durations.project_durations(t), "mean_days"),
    f"SELECT {_DAY_STATISTICS}, count(*) - count(days) AS excluded_missing_dates FROM {_DAYS}",
)
for _label, _column in {
    "agency": "managing_agency", "borough": "borough", "lifecycle": "lifecycle_status",
}.items():
    add(
        f"t10_duration_{_label}",
        lambda t, c=_column: rounded(durations.project_durations(t, group_by=c), "mean_days"),
        f"""SELECT {_column}, {_DAY_STATISTICS}, count(*) - count(days) AS excluded_missing_dates
            FROM {_DAYS} GROUP BY {_column} HAVING count(days) > 0""",
    )

_WANTED = PortfolioFilter(category="Fasteners", borough="B1", agency="BUILDING")
_WANTED_SQL = """(list_contains(boroughs, 'B1') OR borough = 'B1')
    AND list_contains(regexp_split_to_array(trim(sponsor_agency), ' *, *'), 'BUILDING')
    AND pid IN (SELECT pid FROM edges JOIN category_dim USING (fms_id) WHERE category = 'Fasteners')"""
_ROW_COLUMNS = """pid, agency_project_name, managing_agency, sponsor_agency, borough,
    array_to_string(boroughs, '|') AS boroughs, lifecycle_status, current_phase, completion_date,
    completion_date_type, period_variance_days, direction, attributed_budget"""


def _summary_sql(condition: str) -> str:
    return f"""SELECT * FROM (
        WITH kept AS (SELECT * FROM latest_project_state WHERE {condition})
        SELECT count(*) AS n_projects, {_money('attributed_budget')} AS attributed_budget_total,
            count(completion_date) AS n_with_completion_date,
            count(*) FILTER (period_variance_days > 0) AS n_delayed_this_period,
            (SELECT {_money('latest_budget')} FROM lifetime_budget_variance
             WHERE (fms_id, managing_agency) IN (
                 SELECT (fms_id, managing_agency) FROM pid_links WHERE pid IN (SELECT pid FROM kept)))
                AS line_budget_total,
            false AS truncated
        FROM kept)"""


add(
    "t11_portfolio_rows",
    lambda t: joined(portfolio.portfolio_rows(t, _WANTED), "boroughs"),
    f"""SELECT {_ROW_COLUMNS} FROM latest_project_state WHERE {_WANTED_SQL}
        ORDER BY completion_date NULLS LAST, pid""",
)
add("t11_portfolio_summary", lambda t: portfolio.portfolio_summary(t, _WANTED), _summary_sql(_WANTED_SQL))
add("t11_portfolio_summary_all", lambda t: portfolio.portfolio_summary(t), _summary_sql("true"))
add(
    "t11_portfolio_board",
    lambda t: portfolio.portfolio_summary(
        t, PortfolioFilter(community_board="B2 1", lifecycle_status="in_progress")
    ),
    _summary_sql(
        """lifecycle_status = 'in_progress' AND pid IN (
            SELECT pid FROM edges JOIN fms_location USING (fms_id, managing_agency)
            WHERE community_board = 'B2 1')"""
    ),
)

# -- datasets, categories, agencies, ad hoc -----------------------------------------

add(
    "t12_dataset_info",
    lambda t: lookup.dataset_info(t).drop("rows_updated_at"),
    """SELECT dataset_id, any_value(period_column) AS period_column, CAST(sum(n) AS BIGINT) AS row_count,
           any_value(latest_reporting_period) AS latest_reporting_period,
           max(fms_data_date) FILTER (period = latest_reporting_period) AS fms_data_date,
           max(agency_data_date) FILTER (period = latest_reporting_period) AS agency_data_date
       FROM period_rows JOIN full_period USING (dataset_id) GROUP BY dataset_id""",
)
add(
    "t14_categories",
    lambda t: breakdowns.list_categories(t),
    f"""SELECT category, n_budget_lines, round(b, 0) AS total_budget,
            round(100.0 * b / CAST(sum(CAST(b AS DECIMAL(28,6))) OVER () AS DOUBLE), 1) AS pct_budget
        FROM (SELECT category, count(*) AS n_budget_lines, {_money('total_budget')} AS b
              FROM budget_history JOIN category_dim USING (fms_id)
              WHERE reporting_period = {BUDGET_NOW} GROUP BY category)""",
)
add("t15_agencies", lambda t: joined(lookup.list_agencies(t), "aliases"), "SELECT * FROM agency_dim")
add(
    "t15_agencies_contains",
    lambda t: joined(lookup.list_agencies(t, contains="ER"), "aliases"),
    """SELECT * FROM agency_dim WHERE contains(lower(display_name), 'er') OR contains(lower(slug), 'er')""",
)
add(
    "t16_adhoc",
    lambda t: lookup.adhoc(
        t,
        """SELECT category, over_budget, count(*) AS n_lines, max(latest_budget) AS largest
           FROM lifetime_budget_variance JOIN category_dim USING (fms_id)
           GROUP BY category, over_budget -- lines over their last snapshot""",
    ),
    """SELECT category, over_budget, count(*) AS n_lines, max(latest_budget) AS largest
       FROM lifetime_budget_variance JOIN category_dim USING (fms_id) GROUP BY category, over_budget""",
)

add(
    "t16_adhoc_case",
    lambda t: lookup.adhoc(t, "SELECT CATEGORY, count(*) AS n FROM CATEGORY_DIM c GROUP BY 1"),
    "SELECT category AS CATEGORY, count(*) AS n FROM category_dim GROUP BY category",
)
add(
    "t1_resolve_id",
    lambda t: projects.find_schedules(t, "12").where("matched_field = 'pid'"),
    """SELECT pid, agency_project_name, managing_agency, sponsor_agency, lifecycle_status, 'pid' AS matched_field
       FROM newest_history WHERE pid = '12'""",
)

# -- report datasets ----------------------------------------------------------------

add(
    "r1_fanout",
    reports.fan_out,
    f"""SELECT side, managing_agency, count(*) AS n_entities, count(*) FILTER (n = 1) AS n_one_to_one,
            count(*) FILTER (n > 1) AS n_fan_out, CAST(sum(n) AS BIGINT) AS n_links, max(n) AS max_links
        FROM (
            SELECT 'schedule' AS side, min(managing_agency) AS managing_agency, count(*) AS n FROM edges
            WHERE reporting_period = {SCHEDULE_NOW} GROUP BY pid
            UNION ALL
            SELECT 'budget', managing_agency, count(*) FROM edges
            WHERE reporting_period = {SCHEDULE_NOW} GROUP BY fms_id, managing_agency)
        GROUP BY side, managing_agency""",
)
add(
    "r1_fanout_extremes",
    reports.fan_out_extremes,
    f"""SELECT pid, count(*) AS n_links, {_money('commitments')} AS commitments FROM edges
        WHERE reporting_period = {SCHEDULE_NOW} GROUP BY pid ORDER BY n_links DESC, pid LIMIT 20""",
)
add(
    "r1_concentration",
    reports.budget_concentration,
    """SELECT latest_budget, n_lines, CAST(l AS BIGINT) AS cumulative_lines,
           CAST(a AS DOUBLE) AS cumulative_budget,
           round(CAST(a AS DOUBLE) / CAST(sum(amount) OVER () AS DOUBLE), 6) AS cumulative_share
       FROM (SELECT *, sum(n_lines) OVER by_size AS l, sum(amount) OVER by_size AS a
             FROM (SELECT latest_budget, count(*) AS n_lines,
                       sum(CAST(latest_budget AS DECIMAL(28,6))) AS amount
                   FROM lifetime_budget_variance WHERE latest_budget IS NOT NULL GROUP BY latest_budget)
             WINDOW by_size AS (ORDER BY latest_budget DESC ROWS UNBOUNDED PRECEDING))""",
)
_LARGE = """SELECT v.*, round(100.0 * v.spend_to_date / nullif(v.latest_budget, 0), 2) AS spent_pct
    FROM lifetime_budget_variance v JOIN category_dim c USING (fms_id)
    WHERE c.category = 'Ornaments' AND v.latest_budget >= 60000"""
add(
    "r2_big_lines",
    lambda t: reports.big_lines(t, "Ornaments", 60000),
    f"""SELECT b.fms_id, b.managing_agency, b.latest_budget, b.original_budget, b.cumulative_budget_change,
            b.spend_to_date, b.spent_pct, k.pid, k.agency_project_name, k.current_phase,
            k.lifecycle_status, k.sponsor_agency AS sponsor, k.forecast_completion
        FROM ({_LARGE}) b LEFT JOIN (
            SELECT DISTINCT e.fms_id, e.managing_agency AS holder, s.* FROM edges e
            JOIN (SELECT pid, agency_project_name, current_phase, lifecycle_status, sponsor_agency,
                      forecast_completion FROM latest_project_state) s USING (pid)
            WHERE e.reporting_period = {SCHEDULE_NOW}) k
        ON k.fms_id = b.fms_id AND k.holder = b.managing_agency""",
)
add(
    "r2_big_lines_summary",
    lambda t: reports.big_lines_summary(t, "Ornaments", 60000),
    f"""SELECT *, round(100.0 * spend / nullif(budget, 0), 2) AS spent_pct FROM (
            SELECT if(grouping(managing_agency) = 1, 'total', 'agency') AS level, managing_agency,
                count(*) AS n_lines, {_money('latest_budget')} AS budget, {_money('spend_to_date')} AS spend,
                count(*) FILTER (cumulative_budget_change > 0) AS n_above_original
            FROM ({_LARGE}) GROUP BY ROLLUP (managing_agency))""".replace("SELECT *,", "SELECT * EXCLUDE (spend),", 1),
)
add(
    "r3_change_monitor",
    reports.change_monitor,
    f"""SELECT *, {_direction('total_budget_change', 'increased', 'decreased')} AS budget_direction FROM (
            SELECT *, total_budget - lag(total_budget) OVER past AS total_budget_change,
                total_spend - lag(total_spend) OVER past AS total_spend_change,
                delayed_count - lag(delayed_count) OVER past AS delayed_count_change,
                completed_count - lag(completed_count) OVER past AS completed_count_change
            FROM agency_rollup WINDOW past AS (PARTITION BY managing_agency ORDER BY reporting_period))""",
)

_MOVES = f"""
    SELECT *, CASE entity WHEN 'budget' THEN {_direction('movement', 'increased', 'decreased')}
                          ELSE {_direction('movement')} END AS direction FROM (
        SELECT *, row_number() OVER (
            PARTITION BY entity, managing_agency, reporting_period ORDER BY abs(movement) DESC, id) AS rank
        FROM (
            SELECT 'budget' AS entity, fms_id AS id, managing_agency, reporting_period, total_budget AS value,
                lag(total_budget) OVER (PARTITION BY fms_id, managing_agency ORDER BY reporting_period) AS previous_value,
                total_budget - previous_value AS movement
            FROM budget_history
            UNION ALL
            SELECT 'schedule', pid, managing_agency, reporting_period,
                CAST(sum(variance_day) OVER (PARTITION BY pid ORDER BY reporting_period) AS DOUBLE) AS value,
                value - variance_day, CAST(variance_day AS DOUBLE)
            FROM schedule_history WHERE abs(variance_day) <= 36500)
        WHERE movement <> 0)
    WHERE rank <= 10"""
add("r3_watchlist", reports.watchlist, _MOVES)
add(
    "r3_watched_history",
    reports.watched_history,
    f"""SELECT * FROM (WITH listed AS ({_MOVES})
        SELECT w.entity, w.id, w.managing_agency, w.rank, h.reporting_period, h.total_budget AS amount,
            h.spend_to_date AS spend, CAST(NULL AS BIGINT) AS days, CAST(NULL AS VARCHAR) AS lifecycle_status
        FROM listed w JOIN budget_history h ON h.fms_id = w.id AND h.managing_agency IS NOT DISTINCT FROM w.managing_agency
        WHERE w.entity = 'budget' AND w.reporting_period = {BUDGET_NOW}
        UNION ALL
        SELECT w.entity, w.id, w.managing_agency, w.rank, h.reporting_period, NULL, NULL, h.variance_day, h.lifecycle_status
        FROM listed w JOIN schedule_history h ON h.pid = w.id
        WHERE w.entity = 'schedule' AND w.reporting_period = {SCHEDULE_NOW})""",
)
