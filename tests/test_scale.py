"""Plan shapes that must hold at scale: hot keys, pruning, pushdown, no single-task steps."""

import re

import pyarrow as pa
import pytest
from compare import plan_of
from fixtures import BEFORE, FIRST, NOW, detail, raw_frame, schedule, tables, town
from pyspark.sql import functions as F

from capfolio.functions.joins import join_many_to_one
from capfolio.functions.medians import exact_medians, histogram
from capfolio.operators import derive, normalize
from capfolio.operators.breakdowns import budget_breakdown
from capfolio.operators.portfolio import PortfolioFilter, matching_projects, portfolio_rows, portfolio_summary
from capfolio.operators.ranking import pids_in_category, rank_projects
from capfolio.operators.reports import big_lines, watchlist
from capfolio.plans.tables import Tables
from capfolio.sinks import staging
from capfolio.sinks.snapshot import open_published, publish
from capfolio.sources.raw import FrameSource
from capfolio.sources.schemas import RAW_COLUMNS
from capfolio.sources.star import star_tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def small_thresholds(spark):
    """Sizes at which a few thousand rows behave like a cluster's data."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def hot_detail(spark, n=60000):
    """A third of all edges belongs to one schedule, another third to one line."""
    i = F.col("id")
    known = {
        "reporting_period": F.when(i % 6 == 2, "202109").otherwise("202201"),
        "managing_agency": F.lit("BLD"),
        "sponsor_agency": F.lit("FOR"),
        "pid": F.when(i % 3 == 0, "hot").otherwise(i.cast("string")),
        "fms_id": F.when(i % 3 == 1, "HOT").otherwise(F.concat(F.lit("F"), i.cast("string"))),
        "total_budget": F.lit("1"),
        "current_phase": F.lit("Design"),
    }
    return spark.range(n).repartition(8).select(
        *[known.get(c, F.lit(None).cast("string")).alias(c) for c in RAW_COLUMNS["raw_project_detail"]]
    )


def test_hot_schedule_and_line_are_split(spark, small_thresholds):
    n = 60000
    link = normalize.schedule_budget_link(normalize.link_edges(hot_detail(spark, n)))
    found = link.groupBy("n_budgets_for_pid", "n_pids_for_budget").count().collect()
    got = {(r[0], r[1]): r[2] for r in found}
    assert got == {(n // 3, 1): n // 3, (1, n // 3): n // 3, (1, 1): n // 3}
    link.collect()
    assert plan_of(link).count("skew=true") >= 2


def test_hot_schedule_in_links_and_owners(spark, small_thresholds):
    empty = {t: tables(spark).source._frames[t] for t in RAW_COLUMNS}
    t = Tables(spark, FrameSource({**empty, "raw_project_detail": hot_detail(spark)}))
    owners = t["fms_sponsor"]
    assert owners.count() == 40001
    owners.collect()
    assert "skew=true" in plan_of(owners)


def test_many_to_one_null_keys(spark):
    many = spark.createDataFrame(pa.table({"k": ["a", "a", None], "v": [1, 2, 3]}))
    one = spark.createDataFrame(pa.table({"k": ["a", None], "w": [10, 20]}))
    rows = lambda **kw: sorted((r.v, r.w) for r in join_many_to_one(many, one, ["k"], **kw).collect())
    assert rows() == [(1, 10), (2, 10)]
    assert rows(null_matches=True) == [(1, 10), (2, 10), (3, 20)]
    semi = join_many_to_one(many, one, ["k"], "left_semi")
    assert semi.columns == ["k", "v"] and semi.count() == 2


def test_rows_without_a_key_are_not_shuffled(spark, small_thresholds):
    many = spark.range(5000).select(F.when(F.col("id") < 10, F.col("id").cast("string")).alias("k"), "id")
    one = spark.createDataFrame(pa.table({"k": ["1", "2"], "w": [10, 20]}))
    for how in ("inner", "left_semi"):
        plan = plan_of(join_many_to_one(many, one, ["k"], how))
        assert "< 10" in plan[plan.index("Range") - 400:]
        assert join_many_to_one(many, one, ["k"], how).count() == 2
    assert join_many_to_one(many, one, ["k"], "left").count() == 5000


def test_budget_queries_leave_orders_and_customers_alone(spark):
    plan = plan_of(star_tables(spark, FOLDER)["lifetime_budget_variance"])
    assert "orders.parquet" not in plan and "customer.parquet" not in plan
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert not any("l_orderkey" in r and "l_returnflag" in r for r in read)


def test_unused_variance_join_disappears(spark):
    history = town(spark)["schedule_history"]
    assert "Join" in plan_of(history)
    assert "Join" not in plan_of(history.groupBy("managing_agency").count())


def test_period_filter_prunes_published_partitions(spark, tmp_path):
    publish(town(spark), str(tmp_path))
    plan = plan_of(budget_breakdown(open_published(spark, str(tmp_path)), period=NOW))
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert any(NOW in f for f in filters)


def test_watchlist_limits_groups_before_the_shuffle(spark):
    plan = plan_of(watchlist(star_tables(spark, FOLDER), 5))
    for stage in ("Partial", "Final"):
        assert len(re.findall(rf"WindowGroupLimit \[managing_agency#\d+, reporting_period#\d+\].*5, {stage}", plan)) == 2


@pytest.mark.parametrize("uses, most", [
    ({"latest_project_state": 2, "pid_links": 1, "lifetime_budget_variance": 1, "link_edges": 1, "category_dim": 1}, 4),
    ({"link_edges": 2, "latest_project_state": 1, "lifetime_budget_variance": 2, "category_dim": 2}, 4),
    ({"lifetime_budget_variance": 1}, 2),
])
def test_shared_tables_scan_the_facts_once_each(spark, uses, most, monkeypatch):
    read = []
    t = star_tables(spark, FOLDER)
    items = type(t.source)._items
    monkeypatch.setattr(type(t.source), "_items", lambda self, **joins: read.append(joins) or items(self, **joins))
    scans = []
    write = staging.stage
    monkeypatch.setattr(staging, "stage", lambda frame: scans.append(plan_of(frame).count("lineitem.parquet")) or write(frame))
    shared = t.sharing(uses)
    left = sum(plan_of(shared[name]).count("lineitem.parquet") for name in uses)
    assert 1 <= sum(scans) + left <= most
    for name in uses:
        assert sorted(map(str, shared[name].collect())) == sorted(map(str, t[name].collect()))


def test_sharing_reads_what_is_published_or_stored_as_it_is(spark, tmp_path, monkeypatch):
    plain = town(spark)
    publish(plain, str(tmp_path))
    monkeypatch.setattr(staging, "stage", lambda frame: pytest.fail("nothing to stage"))
    opened = open_published(spark, str(tmp_path))
    assert opened.sharing({"latest_project_state": 2, "category_dim": 2})["category_dim"] is opened["category_dim"]
    needs, times = plain.reads({"schedule_history": 1, "fms_location": 1})
    assert {n.table for found in needs.values() for n in found} == {"raw_project_detail", "raw_schedule_history"}
    assert len(needs["raw_project_detail"]) == 2 and times["schedule_spine"] == 1
    assert plain.sharing({"schedule_history": 1, "fms_location": 1}).source is plain.source  # files are read as they are


def test_summaries_and_listings_put_together_only_the_columns_they_read(spark, monkeypatch):
    t = star_tables(spark, FOLDER)
    written = []
    write = staging.stage
    monkeypatch.setattr(staging, "stage", lambda frame: written.append((frame.columns, plan_of(frame))) or write(frame))
    found = portfolio_summary(t)
    (detail,) = [columns for columns, _ in written if "total_budget" in columns]
    assert set(detail) == {"reporting_period", "managing_agency", "pid", "fms_id", "total_budget"}
    assert not any("Window" in plan or "customer.parquet" in plan for _, plan in written)
    assert "Window" not in plan_of(found) and plan_of(found).count("lineitem.parquet") == 1

    written.clear()
    big_lines(t, "Ornaments", 60000)
    assert not any("Window" in plan for _, plan in written)
    held = {c for columns, _ in written for c in columns}
    assert "forecast_completion" in held and not held & {"borough", "budget_variance", "actual_design_start"}


def test_tables_limited_to_some_columns_give_no_others(spark):
    t = star_tables(spark, FOLDER)
    line = ("fms_id", "managing_agency")
    limits = {"latest_project_state": ("pid", "lifecycle_status"), "lifetime_budget_variance": (*line, "original_budget", "spend_pct")}
    shared = t.sharing({name: 1 for name in limits}, limits)
    for name, columns in limits.items():
        assert shared[name].columns == list(columns)
        assert sorted(map(str, shared[name].collect())) == sorted(map(str, t[name].select(*columns).collect()))
    for name in ("schedule_spine", "schedule_history", "budget_history"):
        with pytest.raises(KeyError):
            shared[name]
    whole = t.sharing({"latest_project_state": 1, "schedule_history": 1}, limits)
    assert whole["schedule_history"].where("agency_project_name IS NOT NULL").count() > 0


def test_median_of_a_hot_group_is_selected_from_bands(spark):
    i = F.col("id")
    rows = spark.range(90000).select(
        F.when(i % 3 > 0, "hot").when(i % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), i % 50)).alias("g"),
        F.when(i % 11 > 0, (i * 7919) % 60000 - 20000).alias("days"),
    )
    counts = histogram(rows, ["g"], "days")
    got = {r.g: r.median for r in exact_medians(counts, ["g"], "days").collect()}
    want = {r.g: r.m for r in rows.groupBy("g").agg(F.median("days").alias("m")).where("m IS NOT NULL").collect()}
    assert got == want
    assert "percentile" not in plan_of(exact_medians(counts, ["g"], "days")).lower()
    (whole,) = exact_medians(histogram(rows, [], "days"), [], "days").collect()
    assert whole.median == rows.agg(F.median("days")).first()[0]
    assert exact_medians(histogram(rows.where("days IS NULL"), ["g"], "days"), ["g"], "days").count() == 0
    ends = spark.createDataFrame([(9 * 10**18,), (-9 * 10**18,)], "days long")
    assert exact_medians(histogram(ends, [], "days"), [], "days").first().median == 0.0


def listed(t):
    wanted = PortfolioFilter(category="Fasteners", borough="B1", agency="BUILDING")
    return portfolio_rows(t, wanted), matching_projects(t, wanted).select("pid", "attributed_budget", "completion_date")


def ranked_late(t):
    state = t["latest_project_state"].where("period_variance_days > 0").join(pids_in_category(t, "Fasteners"), "pid", "left_semi")
    best = state.orderBy(F.desc("period_variance_days"), "pid").limit(25)
    found = rank_projects(t, "schedule", "period_variance_days", 25, category="Fasteners", delayed_only=True)
    return found, best.select("pid", "attributed_budget", "period_variance_days")


@pytest.mark.parametrize("made", [listed, ranked_late])
def test_schedules_of_a_category_come_from_details_put_together_once(spark, made, monkeypatch):
    written = []
    write = staging.stage
    monkeypatch.setattr(staging, "stage", lambda frame: written.append((frame.columns, plan_of(frame))) or write(frame))
    found, plain = made(star_tables(spark, FOLDER))
    assert plan_of(found).count("lineitem.parquet") == 1  # the variances; the details are stored
    (lines, scans), (details, assembled), (current, cut) = written
    assert lines == ["fms_id", "category"] and scans.count("lineitem.parquet") == 2
    assert assembled.count("lineitem.parquet") == 1 and "ten_year_plan_category" not in details
    assert current == details and "lineitem.parquet" not in cut
    rows = [str(r) for r in found.select(*plain.columns).collect()]
    assert rows and sorted(rows) == sorted(str(r) for r in plain.collect())


def test_shuffle_files_go_when_a_table_is_stored(spark, monkeypatch):
    held = []
    write = staging.stage
    monkeypatch.setattr(staging, "stage", lambda frame: held.append(spark.conf.get(staging.CLEANUP)) or write(frame))
    before = spark.conf.get(staging.CLEANUP, None)
    counts = staging.stage_all({"n": spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()})["n"]
    assert held == ["true"] and spark.conf.get(staging.CLEANUP, None) == before
    assert counts.count() == 7 and counts.agg(F.sum("count")).first()[0] == 100


def test_current_details_keep_the_newest_links_of_a_schedule_without_newer_ones(spark):
    rows = [
        detail(NOW, "BLD", "FOR", "1", None), detail(BEFORE, "BLD", "FOR", "1", "L1"), detail(BEFORE, "BLD", "FOR", "1", "L1"),
        detail(BEFORE, "BLD", "FOR", "1", None, phase="Old"), detail(FIRST, "BLD", "FOR", "1", "L2"),
        detail(NOW, None, None, "2", "L1"), detail("202203", "BLD", "FOR", "2", "L3"), detail(BEFORE, "BLD", "FOR", "2", "L4"),
        detail(FIRST, "BLD", "FOR", "3", None), detail(NOW, "BLD", "FOR", None, "L1"), detail(None, "BLD", "FOR", "4", "L1"),
    ]
    everything = raw_frame(spark, "raw_project_detail", rows)
    current = normalize.current_details(everything)
    assert current.count() == 5
    same = lambda make: sorted(map(str, make(current).collect())) == sorted(map(str, make(everything).collect()))
    assert same(lambda rows: normalize.schedule_spine(normalize.newest_reports(rows)))
    assert same(lambda rows: derive.pid_links(normalize.edge_rows(rows)))
    t = tables(spark, rows, schedules=[schedule(NOW, "1", "5")])
    stored = Tables(spark, FrameSource(t.source._frames, assembled=True)).sharing({"latest_project_state": 1}, current=True)
    assert stored._current is not None
    assert sorted(map(str, stored["latest_project_state"].collect())) == sorted(map(str, t["latest_project_state"].collect()))
    assert stored.edge_rows().count() == 5 and stored.edge_rows(current=True).count() == 3


def test_parts_are_joined_after_orders(spark, small_thresholds):
    plan = plan_of(star_tables(spark, FOLDER).raw("raw_project_detail", ("fms_id", "sponsor_agency", "ten_year_plan_category")))
    joins = re.findall(r"(?:SortMergeJoin|ShuffledHashJoin) \[(\w+)#", plan)
    assert joins.index("l_partkey") < joins.index("l_orderkey")  # the outermost comes first


def test_records_without_measures_are_those_with_them(spark, tmp_path):
    day = "timestamp_ntz '{}'".format
    items = spark.range(60).select(
        F.col("id").alias("l_orderkey"), F.expr("if(id % 13 = 0, null, id % 7 * 25)").alias("l_partkey"),
        F.expr("if(id % 17 = 0, null, id % 3)").alias("l_suppkey"), F.expr("cast(if(id % 11 = 0, null, id % 8) as int)").alias("l_linenumber"),
        F.expr("cast(if(id % 10 = 0, null, id * 10) as double)").alias("l_extendedprice"), F.lit(0.01).alias("l_discount"),
        F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
        F.expr(f"if(id % 5 = 0, null, {day('1996-11-05')} + make_dt_interval(cast(id % 6 * 40 as int)))").alias("l_shipdate"),
    )
    made = {
        "lineitem": items.union(items.where("l_orderkey % 4 = 1")),
        "supplier": spark.sql("SELECT id AS s_suppkey, cast(id % 2 AS int) AS s_nationkey FROM range(3)"),
        "nation": spark.sql("SELECT cast(id AS int) AS n_nationkey, cast(id AS int) AS n_regionkey FROM range(2)"),
        "region": spark.sql("SELECT cast(id AS int) AS r_regionkey, if(id = 1, null, 'Asia') AS r_name FROM range(2)"),
    }
    for name, frame in made.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    source = star_tables(spark, str(tmp_path)).source
    keys = ("managing_agency", "fms_id", "year_month_reported")
    for not_null in ((), ("fms_id",)):
        lean, full = source.read("raw_budget_history", keys, not_null), source.read("raw_budget_history", (*keys, "total_budget"), not_null)
        assert "Expand" not in plan_of(lean)
        rows = sorted(map(str, lean.collect()))
        assert len(rows) > 20 and rows == sorted(map(str, full.select(*keys).collect()))
