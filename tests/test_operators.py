import pytest
from fixtures import (
    BEFORE, FIRST, GROWN, NOW, OWNED_BUDGET, OWNED_DETAIL, SHARED_BUDGET, SHARED_DETAIL,
    budget, column, detail, keyed, schedule, tables, town,
)

from capfolio.operators import breakdowns, changes, durations, lookup, portfolio, projects, ranking, reports
from capfolio.operators.portfolio import PortfolioFilter


def owned(spark):
    return town(spark, OWNED_DETAIL, OWNED_BUDGET)


def shared(spark):
    return town(spark, SHARED_DETAIL, SHARED_BUDGET)


def moving(spark):
    """Three schedules over two periods, late by so many days."""
    late = [(BEFORE, "m1", "12"), (NOW, "m1", "3"), (BEFORE, "m2", "-6"), (NOW, "m2", "8"), (NOW, "m3", "0")]
    return tables(
        spark, [detail(p, "BLD", "BLD", pid, f"Y{pid}") for p, pid, _ in late],
        schedules=[schedule(*r, reason_for_forecast_completion_change="Weather") for r in late],
    )


# -- breakdowns ----------------------------------------------------------------------


def test_breakdown_statistics(spark):
    t = town(spark)
    row = breakdowns.schedule_breakdown(t, "managing_agency").first()
    assert (row.managing_agency, row.value, row.n) == ("BLD", 2, 2)
    counted = breakdowns.schedule_breakdown(t, "managing_agency", "schedule_variance")
    assert counted.first().value == 1 and "direction" not in counted.columns
    for statistic in ("min", "max", "sum", "mean", "median"):
        row = breakdowns.schedule_breakdown(t, "managing_agency", "schedule_variance", statistic).first()
        assert (row.value, row.direction) == (17, "later")


def test_breakdown_by_owner_and_within_an_agency(spark):
    t = owned(spark)
    assert column(breakdowns.schedule_breakdown(t, "sponsor_agency"), "sponsor_agency") == {"BLD", "FOR", "HRB", "TRM"}
    count = lambda **kw: sum(r.n for r in breakdowns.schedule_breakdown(t, "borough", agency="HRB", **kw).collect())
    assert (count(), count(agency_role="managing")) == (2, 1)


def test_schedules_count_in_each_category_but_money_once(spark):
    t = shared(spark)
    counts = {r.category: r.n for r in breakdowns.schedule_breakdown(t, "category").collect()}
    assert (counts["Reading"], counts["Crossings"], counts["Greens"]) == (3, 1, 2)
    sums = {r.category: r.value for r in breakdowns.budget_breakdown(t, "category").collect()}
    assert (sums["Reading"], sums["Crossings"], sums["Greens"]) == (341.0, 19.0, 436.0)


def test_breakdowns_come_largest_first(spark):
    t = shared(spark)
    for frame in (breakdowns.schedule_breakdown(t, "borough"), breakdowns.budget_breakdown(t)):
        values = [r.value for r in frame.collect()]
        assert len(values) > 1 and values == sorted(values, reverse=True)


def test_a_month_between_periods_is_empty(spark):
    t = town(spark)
    assert breakdowns.schedule_breakdown(t, "borough", period="202202").isEmpty()
    assert breakdowns.budget_breakdown(t, period="202202").isEmpty()


@pytest.mark.parametrize(
    "call",
    [
        lambda t: breakdowns.schedule_breakdown(t, "fms_id"),
        lambda t: breakdowns.schedule_breakdown(t, "borough", "spend"),
        lambda t: breakdowns.schedule_breakdown(t, "borough", "schedule_variance", "mode"),
        lambda t: breakdowns.budget_breakdown(t, "community_board"),
        lambda t: breakdowns.budget_breakdown(t, metric="variance"),
        lambda t: changes.budget_change(t, "HRB", "a", "b"),
        lambda t: changes.budget_change(t, "fms:L1", "a", "b", "variance"),
        lambda t: changes.schedule_changes(t, "completed", "202112", NOW),
        lambda t: changes.schedule_changes(t, "delayed", NOW, BEFORE),
        lambda t: changes.schedule_changes(t, "completed", FIRST, BEFORE),
        lambda t: changes.schedule_changes(t, "vanished", BEFORE, NOW),
        lambda t: ranking.rank_projects(t, "schedule", "spend_to_date"),
        lambda t: ranking.rank_projects(t, "line", "total_budget"),
        lambda t: ranking.rank_projects(t, "budget", "total_budget", direction="Top"),
        lambda t: durations.project_durations(t, group_by="pid"),
        lambda t: durations.project_durations(t, "completion_date"),
        lambda t: portfolio.portfolio_rows(t, PortfolioFilter(lifecycle_status="done")),
    ],
)
def test_arguments_that_make_no_sense(spark, call):
    with pytest.raises(ValueError):
        call(town(spark))


def test_budget_by_role(spark):
    t = owned(spark)
    total = lambda **kw: sum(r.value for r in breakdowns.budget_breakdown(t, agency="HRB", **kw).collect())
    assert (total(), total(agency_role="managing")) == (2164.0, 64.0)


def test_reasons_of_the_late(spark):
    t = moving(spark)
    assert [tuple(r) for r in breakdowns.delay_reasons(t).collect()] == [("Weather", 2)]
    assert [tuple(r) for r in breakdowns.delay_reasons(t, scope="all_history").collect()] == [("Weather", 3)]


# -- changes -------------------------------------------------------------------------


def test_late_now_but_not_before(spark):
    t = moving(spark)
    assert column(changes.schedule_changes(t, "delayed", BEFORE, NOW), "pid") == {"m2"}
    assert column(changes.schedule_changes(t, "delayed", FIRST, NOW), "pid") == {"m1", "m2"}
    assert changes.schedule_change_notes(t, BEFORE) == [] and FIRST in changes.schedule_change_notes(t, FIRST)[0]
    assert changes.budget_change_notes("agency:HRB") and not changes.budget_change_notes("agency:HRB", "managing")


def test_completed_since(spark):
    phases = [
        (NOW, "new", "(Completed)"), (NOW, "gone", "(Withdrawn)"), (BEFORE, "back", "(Cancelled)"), (NOW, "back", "Close-out"),
        (BEFORE, "built", "Construction"), (NOW, "built", "closeout"), (BEFORE, "old", "(Completed)"), (NOW, "old", "(Completed)"),
    ]
    t = tables(spark, [detail(p, "BLD", "TRM", pid, "Y", phase=phase) for p, pid, phase in phases])
    done = lambda **kw: column(changes.schedule_changes(t, "completed", BEFORE, NOW, **kw), "pid")
    assert done() == {"new", "built"} and done(include_cancelled=True) == {"new", "built", "gone"}
    assert done(agency="TRM") == {"new", "built"} and done(agency="HRB") == set()


def test_budget_change(spark):
    t = town(spark)
    row = changes.budget_change(t, "agency:BLD", BEFORE, NOW).first()
    assert (row.from_value, row.to_value, row.change_value, row.change_direction) == (95.0, 565.0, 470.0, "increased")
    line = changes.budget_change(t, "fms:l1", BEFORE, NOW, "spend").first()
    assert (line.from_value, line.to_value, line.change_value) == (12.0, 30.0, 18.0)
    absent = changes.budget_change(t, "fms:L1", FIRST, NOW).first()
    assert (absent.from_value, absent.to_value, absent.change_value, absent.change_direction) == (None, 120.0, None, None)
    every = keyed(changes.budget_changes_by(t, "fms_id", BEFORE, NOW), "fms_id")
    assert every["l1"].change_value == 25.0 and every["l3"].change_value is None


# -- rankings ------------------------------------------------------------------------


def test_rank_schedules(spark):
    t = town(spark, [detail(NOW, "BLD", "BLD", "shed", "L7")], schedules=[schedule(NOW, "shed", "-5")])
    rank = lambda **kw: [r.pid for r in ranking.rank_projects(t, "schedule", "period_variance_days", **kw).collect()]
    assert rank() == ["quay", "shed"] and rank(direction="bottom") == ["shed", "quay"]
    assert rank(direction="bottom", delayed_only=True) == ["quay"] and rank(n=-3) == ["quay"]
    assert rank(agency="BLD", n=90) == ["quay", "shed"] and rank(min_total_budget=50) == ["quay"]
    row = ranking.rank_projects(t, "schedule", "cumulative_variance_days").first()
    assert (row.pid, row.cumulative_variance_days, row.direction) == ("quay", 17, "later")


def test_rank_lines(spark):
    t = owned(spark)
    rank = lambda **kw: ranking.rank_projects(t, "budget", "total_budget", **kw)
    assert [r.fms_id for r in rank(n=3).collect()] == ["P2", "L3", "P3"]
    assert column(rank(min_total_budget=1000), "fms_id") == {"P2"} and column(rank(max_total_budget=50), "fms_id") == {"L2"}
    assert [(r.fms_id, r.sponsor_agencies) for r in rank(agency="HRB").collect()] == [("P2", ["HRB"]), ("P1", ["HRB"])]
    assert rank(agency="trm").first().sponsor_agencies == ["FOR", "TRM"]
    assert column(rank(agency="HRB", agency_role="managing"), "fms_id") == {"P1"}
    assert column(rank(delayed_only=True), "fms_id") == {"L1", "L2"}


def test_rank_by_growth(spark):
    top = ranking.rank_projects(town(spark, budgets=GROWN), "budget", "cumulative_budget_change", 2).collect()
    assert [(r.fms_id, r.cumulative_budget_change, r.direction) for r in top] == [("GR", 175.0, "increased"), ("L1", 25.0, "increased")]


# -- durations and portfolio ---------------------------------------------------------


def test_durations(spark):
    lasting = [(NOW, "BLD", "a", "2018-02-01", "2019-02-01"), (NOW, "HRB", "b", "2019-02-01", "2020-02-11"),
               (NOW, "BLD", "c", "2020-01-01", None), (BEFORE, "BLD", "c", "2020-01-01", "2020-01-02")]
    t = tables(spark, [detail(p, m, None, pid, "Y", actual_design_start=s, actual_construction_end=e) for p, m, pid, s, e in lasting])
    row = durations.project_durations(t).first()
    assert (row.n_projects, row.excluded_missing_dates, row.min_days, row.max_days) == (2, 1, 365, 375)
    grouped = keyed(durations.project_durations(t, group_by="managing_agency"), "managing_agency")
    assert grouped["HRB"].mean_days == 375 and grouped["BLD"].n_projects == 1
    assert (grouped["HRB"].excluded_missing_dates, grouped["BLD"].excluded_missing_dates) == (0, 1)
    empty = durations.project_durations(town(spark)).first()
    assert (empty.n_projects, empty.excluded_missing_dates, empty.mean_days) == (0, 2, None)


def test_portfolio_sums_shares_and_lines(spark):
    t = shared(spark)
    reading = PortfolioFilter(category="Reading")
    s = portfolio.portfolio_summary(t, reading).first()
    assert (s.n_projects, s.attributed_budget_total, s.line_budget_total, s.truncated) == (3, 620.0, 360.0, False)
    assert column(portfolio.portfolio_rows(t, reading), "pid") == {"hall", "annex", "depot"}
    assert portfolio.portfolio_summary(t, reading, n=2).first().truncated is True
    none = portfolio.portfolio_summary(t, PortfolioFilter(borough="Moon")).first()
    assert (none.n_projects, none.attributed_budget_total, none.line_budget_total) == (0, None, None)


def test_portfolio_filters_and_order(spark):
    t = shared(spark)
    pids = lambda **kw: column(portfolio.portfolio_rows(t, PortfolioFilter(**kw)), "pid")
    assert pids(borough="East") == {"barn", "path"} and pids(borough="Multiple") == {"path"}
    assert pids(community_board="South 3") == {"path"} and pids(lifecycle_status="completed") == {"barn"}
    assert pids(agency="FOR") == {"barn", "hall", "annex", "depot", "path"}
    assert [r.pid for r in portfolio.portfolio_rows(t).collect()] == ["quay", "annex", "barn", "depot", "hall", "path"]
    assert [r.pid for r in portfolio.portfolio_rows(t, n=1).collect()] == ["quay"]


def test_listings_have_no_cap(spark):
    t = tables(spark, [detail(NOW, "BLD", "BLD", f"s{i:03d}", f"Y{i}", agency_project_name="Same", fms_project_name="Same") for i in range(620)])
    assert portfolio.portfolio_rows(t).count() == portfolio.portfolio_rows(t, n=10_000).count() == 620
    assert projects.find_schedules(t, "same").count() == projects.find_budget_lines(t, "same").count() == 620
    assert [r.pid for r in projects.find_schedules(t, "same", limit=2).collect()] == ["s000", "s001"]
    assert lookup.adhoc(t, "SELECT pid FROM latest_project_state").count() == 620
    shown = lookup.run_sql(t, "SELECT pid FROM latest_project_state", row_cap=619)
    assert (len(shown.rows), shown.truncated) == (619, True)


# -- look-ups ------------------------------------------------------------------------


def test_find_projects(spark):
    t = town(spark, [detail(BEFORE, "BLD", "BLD", "quay", "L1", agency_project_name="Mud bank", fms_project_name="Dredge 30% more")])
    found = lambda text: {r.pid: (r.agency_project_name, r.matched_field) for r in projects.find_schedules(t, text).collect()}
    assert found("QUAY") == {"quay": ("Quay wall", "pid")}
    assert found("wall") == {"quay": ("Quay wall", "agency_project_name")}
    assert found("mud") == {"quay": ("Mud bank", "agency_project_name")}
    assert found("%") == {} and found("quay_wall") == {} and set(found("seed_b")) == {"barn"}
    assert [(r.fms_id, r.matched_field) for r in projects.find_budget_lines(t, "30%").collect()] == [("L1", "fms_project_name")]
    assert column(projects.find_budget_lines(t, "l1"), "matched_field") == {"fms_id"}


def test_schedule_detail_and_links(spark):
    t = town(spark)
    row = projects.schedule_detail(t, "quay").first()
    assert (row.agency, row.sponsor_agency, row.n_linked, row.direction) == ("BLD", "BLD", 3, "later")
    assert "many-to-many" in row.caveat and "1:1" in projects.schedule_detail(t, "barn").first().caveat
    assert column(projects.schedule_links(t, "quay"), "fms_id") == {"L1", "L2", "L5"}
    assert projects.schedule_detail(t, "nowhere").isEmpty()


def test_a_line_shows_its_newest_links_only(spark):
    links = [(BEFORE, "BLD", "one"), (BEFORE, "BLD", "two"), (NOW, "BLD", "one"), (BEFORE, "HRB", "three")]
    t = tables(spark, [detail(p, m, m, pid, "X") for p, m, pid in links], [budget("BLD", "X", NOW, "28")])
    assert column(projects.budget_links(t, "x"), "pid") == {"one"}
    assert column(projects.budget_links(t, "X", "HRB"), "pid") == {"three"}
    assert column(projects.budget_links(t, by_agency=True), "pid") == {"one", "three"}
    row = projects.budget_detail(t, "x").first()
    assert (row.fms_id, row.n_linked) == ("X", 1) and "1:1" in row.caveat


def test_freshness_skips_a_period_still_arriving(spark):
    arriving = (("201905", 6), ("201909", 6), ("202001", 2), ("202002", 9))
    rows = [detail(p, "H", "H", str(i), "X", fms_data_date=f"{p}-d{i}", agency_data_date="y") for p, n in arriving for i in range(n)]
    # The dataset ids.
    info = keyed(lookup.dataset_info(tables(spark, rows), {"fb86-vt7u": 23}), "dataset_id")
    row, empty = info["fb86-vt7u"], info["qj5n-h5qp"]
    assert (row.row_count, row.latest_reporting_period, row.rows_updated_at) == (23, "201909", 23)
    assert (row.fms_data_date, row.agency_data_date) == ("201909-d5", "y")
    assert (empty.row_count, empty.latest_reporting_period) == (0, None)
    assert list(info) == sorted(info)


# -- ad hoc --------------------------------------------------------------------------


def test_adhoc_rows_and_notes(spark):
    t = town(spark)
    result = lookup.run_sql(t, "SELECT fms_id FROM lifetime_budget_variance ORDER BY 1 -- all", row_cap=2)
    assert ([r.fms_id for r in result.rows], result.truncated, result.latest_reporting_period) == (["L1", "L2"], True, NOW)
    assert "lifetime_budget_variance" in result.note
    whole = lookup.run_sql(t, "WITH x AS (SELECT 'category_dim;' AS v) SELECT * FROM x;")
    assert (whole.rows[0].v, whole.truncated, whole.note) == ("category_dim;", False, None)


def test_adhoc_reads_its_own_dataset(spark):
    small, large = town(spark), shared(spark)
    count = "SELECT count(*) AS n FROM CATEGORY_DIM"
    assert [lookup.adhoc(t, count).first().n for t in (small, large, small)] == [5, 10, 5]
    late, early = lookup.adhoc(small, count), lookup.adhoc(large, count)
    assert (late.first().n, early.first().n) == (5, 10)
    assert not [v.name for v in spark.catalog.listTables() if v.name.startswith("category_dim")]
    nested = "SELECT pid FROM Latest_Project_State WHERE pid IN (SELECT pid FROM `pid_links` WHERE fms_id = 'L3')"
    assert column(lookup.adhoc(small, nested), "pid") == {"barn"}


@pytest.mark.parametrize(
    "query",
    [
        "DROP TABLE category_dim", "INSERT INTO category_dim VALUES (1)", "SELECT 1; SELECT 2",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`", "SELECT * FROM text.`/etc/hosts`",
        "SELECT * FROM somewhere.else", "SELECT * FROM unknown_table",
        "SELECT (SELECT count(*) FROM csv.`/etc/hosts`) FROM category_dim",
    ],
)
def test_adhoc_takes_queries_over_its_own_tables_only(spark, query):
    with pytest.raises(Exception):
        lookup.adhoc(town(spark), query).collect()


# -- reports -------------------------------------------------------------------------


def test_fan_out(spark):
    rows = keyed(reports.fan_out(shared(spark)), "side", "managing_agency")
    pids, lines = rows["schedule", "FOR"], rows["budget", "FOR"]
    assert (pids.n_entities, pids.n_one_to_one, pids.n_fan_out, pids.max_links) == (4, 2, 2, 2)
    assert (lines.n_entities, lines.n_fan_out, lines.n_links, lines.max_links) == (5, 1, 6, 2)
    assert [tuple(r) for r in reports.fan_out_extremes(shared(spark), n=1).collect()] == [("quay", 3, 166.0)]


@pytest.mark.parametrize("ranges", [1, 7, 256])
def test_concentration_matches_a_plain_running_sum(spark, ranges):
    amounts = [(i * 53) % 97 + 2 for i in range(400)]
    t = tables(spark, budgets=[budget("H", f"Y{i}", NOW, str(a)) for i, a in enumerate(amounts)])
    settings = {"spark.sql.shuffle.partitions": str(ranges), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = reports.budget_concentration(t)
        rows = sorted(found.collect(), key=lambda r: -r.latest_budget)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    total, lines, budgets = sum(amounts), 0, 0
    assert len(rows) == len(set(amounts))
    for r in rows:
        same = amounts.count(int(r.latest_budget))
        lines, budgets = lines + same, budgets + same * int(r.latest_budget)
        assert (r.n_lines, r.cumulative_lines, r.cumulative_budget) == (same, lines, budgets)
        assert r.cumulative_share == round(budgets / total, 6)


def test_concentration_keeps_huge_amounts(spark):
    t = tables(spark, budgets=[budget("H", "a", NOW, "1e25"), budget("H", "b", NOW, "4")])
    frame = reports.budget_concentration(t)
    assert [(r.latest_budget, r.cumulative_budget) for r in frame.orderBy("cumulative_lines").collect()] == [(1e25, 1e25), (4.0, 1e25 + 4)]


def test_big_lines_and_monitor(spark):
    t = shared(spark)
    rows = reports.big_lines(t, "Reading", 80).collect()
    assert sorted((r.fms_id, r.pid) for r in rows) == [("RD7", "hall"), ("RD8", "annex"), ("RD8", "depot")]
    levels = {(r.level, r.managing_agency): (r.n_lines, r.budget) for r in reports.big_lines_summary(t, "Reading", 80).collect()}
    assert levels == {("agency", "FOR"): (2, 341.0), ("total", None): (2, 341.0)}
    moves = keyed(reports.change_monitor(t), "managing_agency", "reporting_period")
    assert (moves["BLD", NOW].total_budget_change, moves["BLD", NOW].budget_direction) == (470.0, "increased")


def test_watchlist_ranks_movements_with_ties_by_id(spark):
    periods = ("202405", "202409", "202501")
    amounts = {"L1": (100, 150, 150), "L2": (100, 50, 80), "L3": (10, 12, None), "L4": (5, 5, 5), "L5": (0, 0, 30)}
    budgets = [budget("H", line, p, str(a)) for line, values in amounts.items() for p, a in zip(periods, values) if a is not None]
    days = {"s1": (10, -30), "s2": (30, 0), "s3": (40000, 5)}
    details = [detail(p, "BLD", "FOR", pid, "X") for pid in days for p in periods[:2]]
    late = [schedule(p, pid, str(d)) for pid, values in days.items() for p, d in zip(periods, values)]
    t = tables(spark, details, budgets, late)
    rows = reports.watchlist(t, 2).collect()
    got = {(r.entity, r.managing_agency, r.reporting_period, r["rank"]): (r.id, r.previous_value, r.value, r.movement, r.direction) for r in rows}
    assert got == {
        ("budget", "H", "202409", 1): ("L1", 100.0, 150.0, 50.0, "increased"),  # L2 moved as far: ties go by id
        ("budget", "H", "202409", 2): ("L2", 100.0, 50.0, -50.0, "decreased"),
        ("budget", "H", "202501", 1): ("L2", 50.0, 80.0, 30.0, "increased"),
        ("budget", "H", "202501", 2): ("L5", 0.0, 30.0, 30.0, "increased"),
        ("schedule", "BLD", "202405", 1): ("s2", 0.0, 30.0, 30.0, "later"),  # s3 is beyond the guard
        ("schedule", "BLD", "202405", 2): ("s1", 0.0, 10.0, 10.0, "later"),
        ("schedule", "BLD", "202409", 1): ("s1", 10.0, -20.0, -30.0, "earlier"),
        ("schedule", "BLD", "202409", 2): ("s3", 0.0, 5.0, 5.0, "later"),
    }
    trail = reports.watched_history(t, 1).collect()
    assert sorted((r.id, r.reporting_period, r.amount, r.days) for r in trail) == [
        ("L2", "202405", 100.0, None), ("L2", "202409", 50.0, None), ("L2", "202501", 80.0, None),
        ("s1", "202405", None, 10), ("s1", "202409", None, -30),
    ]
    with pytest.raises(ValueError):
        reports.watchlist(t, 2, ("people",))


# -- order of listings ---------------------------------------------------------------


def ties(spark):
    """Groups that tie in value, one without a name and one without a value."""
    holders = {"B2": 5, "A1": 5, "C3": 9, None: 5}
    details = [
        detail(NOW, holder, f"own{i % 2}", f"{holder}{i}", f"L{holder}{i}", borough="East")
        for holder, n in holders.items() for i in range(n)
    ]
    late = [schedule(NOW, f"{holder}{i}", str(7), reason_for_forecast_completion_change=f"r{i % 2}") for holder in ("B2", "A1") for i in range(4)]
    late += [schedule(NOW, "C30", "30", reason_for_forecast_completion_change="r9")]
    lines = [budget(holder, f"RD{holder}{i}", NOW, "100") for holder, n in holders.items() for i in range(n)]
    lines += [budget("D4", "RDx", NOW, "no number")]
    return tables(spark, details, lines, late)


def test_listings_are_ordered_with_ties_by_name(spark):
    t = ties(spark)
    listed = lambda frame, *names: [tuple(r[n] for n in names) for r in frame.collect()]
    assert listed(breakdowns.schedule_breakdown(t, "managing_agency"), "managing_agency", "value") == [
        ("C3", 9), ("A1", 5), ("B2", 5), (None, 5)
    ]
    for statistic in ("mean", "median", "sum", "min", "max"):
        rows = breakdowns.schedule_breakdown(t, "managing_agency", "schedule_variance", statistic)
        assert [r.managing_agency for r in rows.collect()] == ["C3", "A1", "B2", None], statistic  # no value last
    assert listed(breakdowns.schedule_breakdown(t, "sponsor_agency"), "sponsor_agency", "value") == [("own0", 14), ("own1", 10)]
    assert listed(breakdowns.delay_reasons(t), "reason_for_delay", "n") == [("r0", 4), ("r1", 4), ("r9", 1)]
    assert listed(breakdowns.budget_breakdown(t), "managing_agency", "value") == [
        ("C3", 900.0), ("A1", 500.0), ("B2", 500.0), (None, 500.0), ("D4", None)
    ]
    groups = breakdowns.list_categories(t).collect()
    assert [g.category for g in groups] == [g.category for g in sorted(groups, key=lambda g: (-g.total_budget, g.category))]
    agencies = lookup.list_agencies(t).collect()
    assert [a.slug for a in agencies] == [a.slug for a in sorted(agencies, key=lambda a: (-a.row_count_live, a.slug))]
    assert [r.pid for r in ranking.rank_projects(t, "schedule", "period_variance_days", 4).collect()] == ["C30", "A10", "A11", "A12"]
    assert [r.pid for r in ranking.rank_projects(t, "schedule", "period_variance_days", 2, "bottom").collect()] == ["A10", "A11"]
    lines = ranking.rank_projects(t, "budget", "total_budget", 3).collect()
    assert [r.fms_id for r in lines] == ["RDA10", "RDA11", "RDA12"]
    assert [r.pid for r in portfolio.portfolio_rows(t, n=3).collect()] == ["A10", "A11", "A12"]
    assert [r.n_links for r in reports.fan_out_extremes(t, n=3).collect()] == [1, 1, 1]
