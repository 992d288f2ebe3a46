import pytest
from compare import plan_of
from fixtures import BEFORE, NOW, TOWN_BUDGET, TOWN_DETAIL, detail, keyed, town
from pyspark.sql import functions as F

from capfolio.operators.breakdowns import budget_breakdown, schedule_breakdown
from capfolio.operators.lookup import dataset_info
from capfolio.operators.projects import schedule_detail
from capfolio.operators.changes import schedule_changes
from capfolio.plans.tables import ANALYTIC, NORMALIZED
from capfolio.sinks.export import export_csv, export_with_methodology
from capfolio.sinks.snapshot import content_digests, open_published, publish
from capfolio.sources.raw import read_raw_csv
from capfolio.sources.schemas import RAW_COLUMNS

COLUMNS = RAW_COLUMNS["raw_schedule_history"]


def test_csv_is_text_with_quotes_breaks_and_blanks(spark, tmp_path):
    path = tmp_path / "sched.csv"
    path.write_text(
        "\ufeff" + ",".join(COLUMNS) + "\n"
        '202109,BLD,dyke,"Sea wall, ""old""\nsection",Design,,Actual,007,"",2021-10-02\n'
    )
    row = read_raw_csv(spark, "raw_schedule_history", str(path), multi_line=True).first()
    assert (row.reporting_period, row.agency_project_name) == ("202109", 'Sea wall, "old"\nsection')
    assert (row.completion_date, row.variance_day, row.reason_for_forecast_completion_change) == (None, "007", None)
    # read line by line, such a record fails instead of being misread
    with pytest.raises(Exception):
        read_raw_csv(spark, "raw_schedule_history", str(path)).collect()


def test_csv_of_one_line_records_is_split(spark, tmp_path):
    path = tmp_path / "long.csv"
    line = '202109,BLD,s{},"Wall, ""{}""",Design,,Actual,1,,2021-10-02\n'
    path.write_text(",".join(COLUMNS) + "\n" + "".join(line.format(i, i) for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        frame = read_raw_csv(spark, "raw_schedule_history", str(path))
        assert frame.rdd.getNumPartitions() > 1
        assert frame.count() == frame.select("pid").distinct().count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_reordered_header_is_rejected(spark, tmp_path):
    swapped = [COLUMNS[1], COLUMNS[0], *COLUMNS[2:]]
    path = tmp_path / "a.csv"
    path.write_text(",".join(swapped) + "\n" + ",".join("x" * len(swapped)) + "\n")
    with pytest.raises(ValueError, match="header order"):
        read_raw_csv(spark, "raw_schedule_history", str(path))


def test_every_file_of_a_folder_is_checked(spark, tmp_path):
    good, bad = ",".join(COLUMNS), ",".join([COLUMNS[1], COLUMNS[0], *COLUMNS[2:]])
    (tmp_path / "a.csv").write_text(good + "\n" + ",".join("x" * 10) + "\n")
    (tmp_path / "b.csv").write_text(bad + "\n" + ",".join("y" * 10) + "\n")
    with pytest.raises(Exception):
        read_raw_csv(spark, "raw_schedule_history", str(tmp_path)).collect()


def test_publish_and_reopen(spark, tmp_path):
    t = town(spark)
    with pytest.raises(Exception):
        open_published(spark, str(tmp_path))
    first = publish(t, str(tmp_path), "zz-named")
    second = publish(t, str(tmp_path), rows_updated_at={"gyhf-rsr3": 5})
    assert first > second  # what counts is when they were published
    again = open_published(spark, str(tmp_path), (), snapshot=first)
    newest = open_published(spark, str(tmp_path))
    for name in (*NORMALIZED, *ANALYTIC):
        left, right = t[name], newest[name]
        assert left.columns == right.columns and left.dtypes == right.dtypes
        assert sorted(map(repr, left.collect())) == sorted(map(repr, right.collect())), name
        assert again[name].count() == left.count()
    # operators read the snapshot's files
    assert budget_breakdown(newest).first().value == 565.0
    assert schedule_breakdown(newest, "managing_agency").first().n == 2
    assert keyed(schedule_detail(newest), "pid")["quay"].n_linked == 3
    assert schedule_changes(newest, "delayed", BEFORE, NOW).first().pid == "quay"
    assert newest["meta"].where(F.col("ingest_completed_at").isNotNull()).count() == 4
    assert {r.rows_updated_at for r in dataset_info(newest).collect()} == {None, 5}
    assert "raw_" not in plan_of(dataset_info(newest))
    assert "raw_" not in plan_of(budget_breakdown(newest)) and "max(reporting_period" not in plan_of(budget_breakdown(newest))
    assert newest.raw("raw_project_detail", ("pid",)).count() == len(TOWN_DETAIL)
    assert newest.raw("raw_budget_history", ("fms_id",)).count() == len(TOWN_BUDGET)


def test_unfinished_snapshot_is_invisible(spark, tmp_path):
    t = town(spark)
    done = publish(t, str(tmp_path), "20260101T000000-a")
    t["budget_history"].write.parquet(str(tmp_path / "snapshot=20270101T000000-b" / "budget_history"))
    assert open_published(spark, str(tmp_path))["budget_history"].count() == 4
    with pytest.raises(ValueError):
        open_published(spark, str(tmp_path), snapshot="20270101T000000-b")
    with pytest.raises(Exception):
        publish(t, str(tmp_path), done)


def files_below(folder):
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def test_only_periods_that_changed_are_written_again(spark, tmp_path):
    first = publish(town(spark), str(tmp_path), "s1")
    old = files_below(tmp_path / "data")
    assert any("build=s1" in f and NOW in f for f in old)

    # the same rows in another order: nothing by period is written
    t = town(spark)
    for name in RAW_COLUMNS:
        t.source._frames[name] = t.source._frames[name].orderBy(F.rand(3)).repartition(3)
    publish(t, str(tmp_path), "s2")
    assert files_below(tmp_path / "data") == old

    # one schedule of the newest period changes, and a period is added
    more = town(spark, [detail(NOW, "BLD", "BLD", "mole", "L9", "5"), detail("202205", "BLD", "BLD", "mole", "L9", "6")])
    publish(more, str(tmp_path), "s3")
    new = {f: at for f, at in files_below(tmp_path / "data").items() if f not in old}
    assert {f.split("/")[0] for f in new} == {"raw_project_detail", "schedule_budget_link", "schedule_history"}
    assert {f.split("/")[1].split("=")[1] for f in new} == {NOW, "202205"} and all("build=s3" in f for f in new)
    assert {f: at for f, at in files_below(tmp_path / "data").items() if f in old} == old
    opened, again = open_published(spark, str(tmp_path)), open_published(spark, str(tmp_path), snapshot=first)
    for name in (*NORMALIZED, *ANALYTIC):
        assert sorted(map(repr, opened[name].collect())) == sorted(map(repr, more[name].collect())), name
        assert sorted(map(repr, again[name].collect())) == sorted(map(repr, town(spark)[name].collect())), name
    for name, columns in RAW_COLUMNS.items():
        assert sorted(map(repr, opened.raw(name, columns).collect())) == sorted(map(repr, more.raw(name, columns).collect()))

    # a period that is gone takes its rows along
    publish(town(spark), str(tmp_path), "s4")
    last = open_published(spark, str(tmp_path))
    assert sorted(map(repr, last["schedule_history"].collect())) == sorted(map(repr, town(spark)["schedule_history"].collect()))


def test_digests_tell_rows_apart_and_not_their_order(spark):
    layout = "p string, a string, b string"
    digests = lambda *rows: content_digests(spark.createDataFrame(list(rows), layout), "p")
    rows = [("1", "x", None), ("1", None, "x"), ("2", "y", "z"), (None, "q", "q")]
    whole = digests(*rows)
    assert set(whole) == {"1", "2", None} and whole == digests(*rows[::-1])
    assert digests(rows[0])["1"] != digests(rows[1])["1"]  # the column of a NULL counts
    assert digests(rows[2], rows[2])["2"] != whole["2"] and digests(rows[2], rows[2], rows[2])["2"] != whole["2"]


def test_snapshot_of_another_layout_is_refused(spark, tmp_path, monkeypatch):
    publish(town(spark), str(tmp_path))
    monkeypatch.setitem(RAW_COLUMNS, "raw_budget_fy", ["fms_id", "city"])
    with pytest.raises(ValueError, match="raw_budget_fy"):
        open_published(spark, str(tmp_path))


def test_exports(spark, tmp_path):
    state = town(spark)["latest_project_state"]
    first, second = export_csv(state, str(tmp_path)), export_csv(state, str(tmp_path))
    assert first != second
    back = spark.read.option("header", True).option("escape", '"').csv(first)
    assert back.count() == 2 and back.where("pid = 'quay'").first().boroughs == '["North"]'
    out = export_with_methodology(state, str(tmp_path), {"definition": "d", "n": 2})
    assert spark.read.parquet(f"{out}/data").count() == 2
    notes = spark.read.option("header", True).csv(f"{out}/methodology").collect()
    assert {r.key: r.value for r in notes} == {"definition": "d", "n": "2"}
