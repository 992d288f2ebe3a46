"""Raw tables derived from a sales star schema (TPC-H-like parquet tables).

A line item plays the detail row, its part the budget line, its customer the schedule and
its supplier's region the managing agency. Only the joins that the requested columns need
are planned, so a query on budgets never touches orders or customers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from capfolio.functions.periods import in_cadence
from capfolio.sources.dictionaries import Agency, Category, Taxonomy
from capfolio.sources.raw import required
from capfolio.sources.schemas import RAW_COLUMNS

STAR_AGENCIES = tuple(
    Agency(name.lower(), name.title(), (name.title(),), name, True, "managing")
    for name in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "LEGACY")
) + tuple(
    Agency(name.lower(), name.title(), (name.title(),), name, False, "sponsor")
    for name in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
) + (Agency("council", "City Council", ("City Council",)),)

STAR_TAXONOMY = Taxonomy(
    (
        Category("Legacy Owner", ever_managed_by=("LEGACY",)),
        Category("Line Prefix 19", prefixes=("F19",)),
        Category("Fasteners", keywords=("bolt", "rod")),
        Category("Ornaments", keywords=("ring",), sponsors=("HOUSEHOLD",)),
        Category("Machinery", sponsors=("MACHINERY",)),
        Category("Automotive", sponsors=("AUTOMOBILE",)),
        Category("General", keywords=("plate", "gizmo"), sponsors=("BUILDING",), generic=True),
    )
)

# Declared so that planning never opens a file; only columns used here are listed.
_SCHEMAS = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_extendedprice double, l_discount double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "customer": "c_custkey bigint, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_type string, p_size int",
}

_MONEY = "decimal(18,2)"

# Which joins each detail column needs beyond the line item itself.
_NEEDS_ORDERS = {
    "pid", "sponsor_agency", "agency_project_name", "agency_project_description",
    "current_phase", "forecast_completion", "actual_design_start", "actual_construction_end",
    "agency_data_date",
}
_NEEDS_CUSTOMER = {"sponsor_agency", "agency_project_description"}
_NEEDS_REGION = {"managing_agency", "sponsor_agency"}
_NEEDS_PART = {"borough", "community_board", "ten_year_plan_category", "fms_project_name"}
_FROM_KEYS = {"pid", "fms_id", "agency_project_name", "total_budget"}


def _month_text(day: Column) -> Column:
    return (F.year(day) * 100 + F.month(day)).cast("string")


def _day_text(day: Column) -> Column:
    return day.cast("date").cast("string")


def _period_number() -> Column:
    day = F.col("l_shipdate")
    month = F.month(day)
    third = F.when(month <= 4, 1).when(month <= 8, 5).otherwise(9)
    return F.year(day) * 100 + F.when(F.col("l_linenumber") == 7, month).otherwise(third)


def _period() -> Column:
    return _period_number().cast("string")


def _line_text(part: Column) -> Column:
    return F.concat(F.lit("F"), part.cast("string"))


def _has_schedule() -> Column:
    return F.col("l_partkey") % 5 >= 2


def _agency() -> Column:
    reassigned = (F.col("l_partkey") % 50 == 0) & (
        F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    )
    return F.when(reassigned, "LEGACY").otherwise(F.col("r_name"))


def _phase() -> Column:
    status, flag = F.col("o_orderstatus"), F.col("l_returnflag")
    return (
        F.when(
            status == "O",
            F.when(F.col("l_linestatus") == "F", "Construction procurement").otherwise("Construction"),
        )
        .when(status == "P", F.when(flag == "R", "(Cancelled)").otherwise("Design"))
        .otherwise(F.when(flag == "R", "closeout").when(flag == "A", "Construction").otherwise("Design"))
    )


def _borough() -> Column:
    size = F.col("p_size")
    return F.when(size % 7 == 0, "Citywide").when(
        size % 11 != 0, F.concat(F.lit("B"), (size % 5).cast("string"))
    )


def _detail_columns() -> dict[str, Column]:
    customer, segment = F.col("o_custkey"), F.col("c_mktsegment")
    built = (
        (F.col("o_orderstatus") == "F") & (F.col("l_returnflag") == "R") & (F.col("l_discount") < 0.03)
    )
    return {
        "reporting_period": _period(),
        "managing_agency": _agency(),
        "sponsor_agency": F.when(
            customer % 20 == 0, F.concat(segment, F.lit(", "), F.col("r_name"))
        ).otherwise(segment),
        "pid": F.when(_has_schedule(), customer.cast("string")),
        "fms_id": _line_text(F.col("l_partkey")),
        "total_budget": F.col("l_extendedprice").cast(_MONEY).cast("string"),
        "fms_project_name": F.col("p_name"),
        "agency_project_name": F.concat(F.lit("Project "), customer.cast("string")),
        "agency_project_description": F.concat(segment, F.lit(" program")),
        "current_phase": _phase(),
        "forecast_completion": F.when(
            F.col("o_orderstatus") != "F",
            _day_text(F.date_add("l_shipdate", 90)),
        ),
        "actual_design_start": _day_text(F.col("o_orderdate")),
        "actual_construction_end": F.when(built, _day_text(F.col("l_shipdate"))),
        "borough": _borough(),
        "community_board": F.concat(
            _borough(), F.lit(" "), (F.col("p_size") % 3).cast("string")
        ),
        "ten_year_plan_category": F.concat("p_type", F.lit(" "), "p_name"),
        "agency_data_date": _day_text(F.col("o_orderdate")),
        "fms_data_date": _day_text(F.last_day("l_shipdate")),
    }


class StarSource:
    """The raw-table contract over ``<folder>/<table>.parquet``."""

    assembled = True
    #: Grouped by just the columns that tell their records apart.
    without_repeats = frozenset(("raw_budget_history", "raw_schedule_history"))

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self._folder = folder.rstrip("/")
        self._opened: dict[str, DataFrame] = {}

    def _table(self, name: str) -> DataFrame:
        if name not in self._opened:
            reader = self._spark.read.schema(_SCHEMAS[name])
            self._opened[name] = reader.parquet(f"{self._folder}/{name}.parquet")
        return self._opened[name]

    def _items(self, *, orders: bool = False, customer: bool = False, region: bool = False) -> DataFrame:
        rows = self._table("lineitem")
        if region:
            named = self._table("region").withColumn("r_name", F.upper("r_name"))
            # One dimension at a time: Spark sizes a join of dimensions as their product,
            # and would rather broadcast the line items than that.
            rows = (
                rows.join(self._table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
                .join(self._table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
                .join(named, F.col("n_regionkey") == F.col("r_regionkey"))
            )
        if orders or customer:
            head = self._table("orders")
            if customer:
                head = head.join(self._table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            rows = rows.join(head, F.col("l_orderkey") == F.col("o_orderkey"))
        return rows

    def read(
        self,
        table: str,
        columns: Sequence[str],
        not_null: Sequence[str] = (),
        is_null: Sequence[str] = (),
    ) -> DataFrame:
        if table == "raw_budget_history":
            frame = self._raw_budget_history(frozenset(columns), "spend_to_date" in not_null, "spend_to_date" in is_null)
        else:
            frame = getattr(self, f"_{table}")(frozenset(columns), frozenset(not_null))
        kept = [c for c in not_null if c in columns and c != "pid"]
        return required(frame, kept, is_null).select(*columns)

    def latest_cadence_period(self, table: str, not_null: Sequence[str] = ()) -> DataFrame:
        """Grouping never adds or drops a period, so the line items alone decide.

        As everywhere in this mapping, keys are taken to be valid: joins are planned only for columns that are asked
        for, so a line item without its order or part still counts where none of them is.
        """
        rows = self._table("lineitem")
        if table == "raw_schedule_history" or "pid" in not_null:
            rows = rows.where(_has_schedule())
        periods = rows.select(_period().alias("period"))
        return periods.where(in_cadence(F.col("period"))).agg(F.max("period").alias("period"))

    def _raw_project_detail(self, columns: frozenset[str], not_null: frozenset[str]) -> DataFrame:
        orders, part = bool(columns & _NEEDS_ORDERS), bool(columns & _NEEDS_PART)
        rows = self._items(
            orders=orders, customer=bool(columns & _NEEDS_CUSTOMER), region=bool(columns & _NEEDS_REGION)
        )
        if "pid" in not_null:
            rows = rows.where(_has_schedule())
        known = _detail_columns()
        if part:
            # Last, so that a part's long texts are not shuffled to its orders; what the other tables decide is made before,
            # being shorter than the columns behind it. Keys and prices are shorter than their texts.
            early = sorted(c for c in columns & known.keys() if c not in _NEEDS_PART | _FROM_KEYS)
            keys = ("l_partkey", "l_extendedprice", *(("o_custkey",) if orders else ()))
            rows = rows.select(*keys, *[known[c].alias(c) for c in early])
            rows = rows.join(self._table("part"), F.col("l_partkey") == F.col("p_partkey"))
            known |= {c: F.col(c) for c in early}
        absent = F.lit(None).cast("string")
        return rows.select(
            *[known.get(c, absent).alias(c) for c in RAW_COLUMNS["raw_project_detail"] if c in columns]
        )

    def _spend(self) -> Column:
        rest = F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
        return (F.col("l_extendedprice").cast(_MONEY) * rest).cast(_MONEY)

    def _raw_budget_history(self, columns: frozenset[str], only_snapshots: bool, only_adopted: bool) -> DataFrame:
        # The agency is part of both group keys, so it is needed whatever is asked for.
        items = self._items(region=True)
        if only_snapshots:
            return self._snapshots(items)
        if only_adopted:
            return self._adopted(items)
        if columns <= {"managing_agency", "fms_id", "year_month_reported"}:
            return self._records(items)
        return self._snapshots_and_adopted(items)

    def _records(self, items: DataFrame) -> DataFrame:
        """Line, agency and month of both kinds of record, without the measures.

        Grouped by agency and line, with the set of their periods, which the calendar bounds: a line's records then come out
        of one task, and adopted records need no second copy of all line items.
        """
        lines = items.groupBy(_agency().alias("managing_agency"), "l_partkey").agg(
            F.collect_set(_period_number()).alias("periods"),
            F.bool_or(_period_number().isNull()).alias("undated"),
            F.min("l_shipdate").alias("first_day"),
        )
        months = F.transform("periods", lambda p: p.cast("string"))
        undated = F.when(F.col("undated"), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
        adopted = F.when(F.col("l_partkey") % 3 == 0, F.array(_month_text(F.col("first_day")))).otherwise(
            F.array().cast("array<string>")
        )
        return lines.select(
            "managing_agency", _line_text(F.col("l_partkey")).alias("fms_id"),
            F.explode(F.concat(months, undated, adopted)).alias("year_month_reported"),
        )

    def _snapshots(self, items: DataFrame) -> DataFrame:
        # Numbers are grouped and made texts after: every line item has keys, and few have the same.
        sums = items.groupBy(_agency().alias("managing_agency"), "l_partkey", _period_number().alias("period")).agg(
            F.sum(F.col("l_extendedprice").cast(_MONEY)).alias("total"), F.sum(self._spend()).alias("spend")
        )
        return self._with_moves(
            sums.select(
                "managing_agency", _line_text(F.col("l_partkey")).alias("fms_id"),
                F.col("period").cast("string").alias("year_month_reported"), "total", "spend",
            ),
            (),
        )

    def _with_moves(self, sums: DataFrame, apart: Sequence[str]) -> DataFrame:
        """Snapshots with the change since the one before; ``apart`` are further columns that tell lines apart."""
        by_time = W.partitionBy("managing_agency", "fms_id", *apart).orderBy("year_month_reported")
        total, spend, move = F.col("total"), F.col("spend"), F.col("move")
        return sums.withColumn("move", total - F.lag("total").over(by_time)).select(
            "managing_agency", "fms_id", "year_month_reported",
            total.cast("string").alias("total_budget"),
            spend.cast("string").alias("spend_to_date"),
            self._percent(spend, total).alias("spend_to_date_1"),
            move.cast("string").alias("budget_variance"),
            self._percent(move, total - move).alias("budget_variance_1"),
        )

    def _snapshots_and_adopted(self, items: DataFrame) -> DataFrame:
        """Both kinds of record from one scan: grouping sets with and without the period."""
        keyed = items.select(
            _agency().alias("managing_agency"), "l_partkey", _period_number().alias("period"), "l_shipdate",
            F.col("l_extendedprice").cast(_MONEY).alias("price"), self._spend().alias("paid"),
        )
        line, snapshot = ["managing_agency", "l_partkey"], ["managing_agency", "l_partkey", "period"]
        sums = keyed.groupingSets([snapshot, line], *snapshot).agg(
            (F.grouping("period") == 1).alias("adopted"), F.sum("price").alias("sum_price"), F.sum("paid").alias("sum_paid"),
            F.min("price").alias("least_price"), F.min("l_shipdate").alias("first_day"),
        )
        adopted = F.col("adopted")
        return self._with_moves(
            sums.where(~adopted | (F.col("l_partkey") % 3 == 0)).select(
                "managing_agency", _line_text(F.col("l_partkey")).alias("fms_id"), "adopted",
                F.when(adopted, _month_text(F.col("first_day"))).otherwise(F.col("period").cast("string")).alias("year_month_reported"),
                F.when(adopted, F.col("least_price")).otherwise(F.col("sum_price")).alias("total"),
                F.when(~adopted, F.col("sum_paid")).alias("spend"),
            ),
            ("adopted",),
        )

    @staticmethod
    def _percent(part: Column, whole: Column) -> Column:
        ratio = F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
        return F.round(ratio, 2).cast(_MONEY).cast("string")

    def _adopted(self, items: DataFrame) -> DataFrame:
        absent = F.lit(None).cast("string")
        return (
            items.where(F.col("l_partkey") % 3 == 0)
            .groupBy(_agency().alias("managing_agency"), "l_partkey")
            .agg(
                _month_text(F.min("l_shipdate")).alias("year_month_reported"),
                F.min(F.col("l_extendedprice").cast(_MONEY)).cast("string").alias("total_budget"),
            )
            .select(
                "managing_agency", _line_text(F.col("l_partkey")).alias("fms_id"), "year_month_reported", "total_budget",
                *[
                    absent.alias(c)
                    for c in ("spend_to_date", "spend_to_date_1", "budget_variance", "budget_variance_1")
                ],
            )
        )

    def _raw_schedule_history(self, columns: frozenset[str], not_null: frozenset[str]) -> DataFrame:
        items = self._items(orders=True, region="managing_agency" in columns)
        late = F.datediff("l_shipdate", "o_orderdate") % 400
        days = F.min(late)
        measures = {
            "managing_agency": lambda: F.min(_agency()),
            "agency_project_name": lambda: F.min(F.concat(F.lit("Project "), F.col("o_custkey").cast("string"))),
            "current_phase": lambda: F.min(_phase()),
            "completion_date": lambda: _day_text(F.min("l_shipdate")),
            "completion_date_type": lambda: F.when(
                F.bool_or(F.col("o_orderstatus") == "F"), "Actual"
            ).otherwise("Forecast"),
            "variance_day": lambda: days.cast("string"),
            "reason_for_forecast_completion_change": lambda: F.when(
                days > 0, F.min("o_orderpriority")
            ),
            "data_date": lambda: _day_text(F.max("o_orderdate")),
        }
        wanted = [make().alias(c) for c, make in measures.items() if c in columns]
        return (
            items.where(_has_schedule())
            .groupBy(_period_number().alias("period"), "o_custkey")
            .agg(*(wanted or [F.count("*").alias("n")]))
            .withColumns({"reporting_period": F.col("period").cast("string"), "pid": F.col("o_custkey").cast("string")})
        )

    def _raw_budget_fy(self, columns: frozenset[str], not_null: frozenset[str]) -> DataFrame:
        price = F.col("l_extendedprice").cast(_MONEY)
        own = F.col("l_discount") < 0.05
        year = F.year("l_shipdate") + F.when(F.month("l_shipdate") >= 7, 1).otherwise(0)
        zero = F.lit(0).cast(_MONEY)
        return (
            self._items(region=True)
            .groupBy(_period_number().alias("period"), _agency().alias("managing_agency"), "l_partkey", year.alias("year"))
            .agg(
                F.sum(price).cast("string").alias("total_budget_city_non_city"),
                F.sum(F.when(own, price).otherwise(zero)).cast("string").alias("city"),
                F.sum(F.when(own, zero).otherwise(price)).cast("string").alias("non_city"),
                F.sum(self._spend()).cast("string").alias("spend"),
            )
            .withColumns({
                "reporting_period": F.col("period").cast("string"), "fms_id": _line_text(F.col("l_partkey")),
                "fiscal_year": F.col("year").cast("string"),
            })
        )


def star_tables(spark: SparkSession, folder: str):
    """The table graph over a star-schema folder with its agencies and taxonomy."""
    from capfolio.plans.tables import Tables

    return Tables(spark, StarSource(spark, folder), STAR_AGENCIES, STAR_TAXONOMY)
