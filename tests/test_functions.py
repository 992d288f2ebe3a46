import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from capfolio.functions.casts import money_sum, to_date, to_double, to_int, to_long
from capfolio.functions.periods import is_cadence_period, latest_full_period
from capfolio.functions.signs import direction, link_caveat
from capfolio.functions.text import owned_by


def texts(spark, values):
    return spark.createDataFrame(pa.table({"x": pa.array(values, pa.string())}))


def test_casts(spark):
    x = F.col("x")
    values = ["45", "45.6", "-45.5", " 7 ", "7d", "1e3", "", "abc", None, "2026", "2026-01", "2026-01-05", "99999999999999999999"]
    rows = texts(spark, values).select("x", to_double(x).alias("d"), to_long(x).alias("l"), to_int(x).alias("i"), to_date(x).cast("string").alias("t")).collect()
    got = {r.x: (r.d, r.l, r.i, r.t) for r in rows}
    assert got["45"] == (45.0, 45, 45, None) and got["45.6"] == (45.6, 46, 46, None)
    assert got["-45.5"][1] == -46 and got[" 7 "][:2] == (7.0, 7) and got["1e3"][:2] == (1000.0, 1000)
    for bad in ("7d", "", "abc", None):
        assert got[bad] == (None, None, None, None)
    assert got["2026"][3] is None and got["2026-01"][3] is None and got["2026-01-05"][3] == "2026-01-05"
    assert got["99999999999999999999"][1] is None


def test_money_sum_keeps_what_decimal_cannot_hold(spark):
    total = lambda *values: texts(spark, list(values)).agg(money_sum(F.col("x").cast("double"))).first()[0]
    assert total("1e25", "5") == 1e25 + 5 and total("-Infinity", "2") == float("-inf")
    assert total("NaN", "1") != total("NaN", "1") and total(None, None) is None


def test_money_sum_does_not_drift(spark):
    assert texts(spark, ["0.1"] * 10).agg(money_sum(F.col("x").cast("double"))).first()[0] == 1.0


@pytest.mark.parametrize("period,expected", [("201801", True), ("201905", True), ("202009", True), ("201802", False), ("201912", False), ("", False), ("bogus", False), (None, False), ("2018011", False)])
def test_cadence(period, expected):
    assert is_cadence_period(period) is expected


@pytest.mark.parametrize(
    "counts,expected",
    [
        ({"201905": 310, "201909": 305, "202001": 330, "202002": 2, "201812": 41}, "202001"),
        ({"201905": 900, "201909": 880, "202001": 30}, "201909"),
        ({"202003": 12}, None),
    ],
)
def test_full_period(spark, counts, expected):
    frame = spark.createDataFrame(pa.table({"period": list(counts), "n": list(counts.values())}))
    row = latest_full_period(frame).first()
    assert (row.row_count, row.latest_reporting_period) == (sum(counts.values()), expected)


def test_signs_and_caveats(spark):
    x = F.col("x").cast("double")
    got = {r.x: (r.s, r.b) for r in texts(spark, ["45", "-3", "0", None]).select("x", direction(x).alias("s"), direction(x, "budget").alias("b")).collect()}
    assert got == {"45": ("later", "increased"), "-3": ("earlier", "decreased"), "0": ("unchanged", "unchanged"), None: (None, None)}
    notes = [r[0] for r in texts(spark, ["0", "1", "3"]).select(link_caveat(F.col("x").cast("int"), "budget")).collect()]
    assert notes[0].startswith("no linked") and "1:1" in notes[1] and "3 linked" in notes[2]


def test_owner_match_is_per_atom(spark):
    rows = texts(spark, ["DOT, DPR", "DOTX", " DPR ,DOT", None, ""])
    assert {r.x for r in rows.where(owned_by(F.col("x"), ["DOT"])).collect()} == {"DOT, DPR", " DPR ,DOT"}
