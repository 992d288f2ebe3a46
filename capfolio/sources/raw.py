"""The raw-table contract, and its CSV / Parquet implementation."""

from __future__ import annotations

import csv as _csv
from collections.abc import Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capfolio.functions.periods import in_cadence
from capfolio.sources.schemas import DATASETS, RAW_COLUMNS, raw_schema


class RawSource(Protocol):
    """Where the four raw tables come from.

    ``assembled`` tells whether a table is put together at each reading (joined, parsed), so that reading a stored copy is cheaper.
    ``without_repeats`` names the tables of which no two records (of one kind) share line, agency or schedule and period.
    """

    assembled: bool
    without_repeats: frozenset[str]

    def read(
        self,
        table: str,
        columns: Sequence[str],
        not_null: Sequence[str] = (),
        is_null: Sequence[str] = (),
    ) -> DataFrame:
        """``columns`` of ``table``, from rows with and without a value as asked.

        Stating both conditions here lets a source skip work that a later filter could
        not undo, such as a join that only serves the rows left out.
        """

    def latest_cadence_period(self, table: str, not_null: Sequence[str] = ()) -> DataFrame:
        """One row, one column: the greatest in-cadence period among those rows."""


def required(
    frame: DataFrame, not_null: Sequence[str], is_null: Sequence[str] = ()
) -> DataFrame:
    present = reduce(lambda df, c: df.where(F.col(c).isNotNull()), not_null, frame)
    return reduce(lambda df, c: df.where(F.col(c).isNull()), is_null, present)


def period_column(table: str) -> str:
    return next(d.period_column for d in DATASETS if d.table == table)


class FrameSource:
    """Raw tables given as DataFrames (CSV, Parquet or built in memory)."""

    def __init__(self, frames: dict[str, DataFrame], assembled: bool = False):
        self._frames = frames
        self.assembled = assembled
        self.without_repeats: frozenset[str] = frozenset()

    def read(
        self,
        table: str,
        columns: Sequence[str],
        not_null: Sequence[str] = (),
        is_null: Sequence[str] = (),
    ) -> DataFrame:
        return required(self._frames[table], not_null, is_null).select(*columns)

    def latest_cadence_period(self, table: str, not_null: Sequence[str] = ()) -> DataFrame:
        period = period_column(table)
        rows = required(self._frames[table], not_null).where(in_cadence(F.col(period)))
        return rows.agg(F.max(period).alias("period"))


class StagedSource(FrameSource):
    """Some raw tables from stored copies that hold the columns and rows asked for, the others from ``source``."""

    def __init__(self, source: RawSource, frames: dict[str, DataFrame]):
        super().__init__(frames)
        self._source = source
        self.without_repeats = source.without_repeats

    def read(
        self,
        table: str,
        columns: Sequence[str],
        not_null: Sequence[str] = (),
        is_null: Sequence[str] = (),
    ) -> DataFrame:
        owner = super() if table in self._frames else self._source
        return owner.read(table, columns, not_null, is_null)

    def latest_cadence_period(self, table: str, not_null: Sequence[str] = ()) -> DataFrame:
        owner = super() if table in self._frames else self._source
        return owner.latest_cadence_period(table, not_null)


def check_header(spark: SparkSession, table: str, path: str) -> None:
    """Raise unless the file's header is exactly the declared list, in order.

    Columns are matched by position and everything is text, so a reordered file would
    load without any other sign of trouble.
    """
    first = spark.read.text(path).limit(1).collect()
    line = first[0]["value"].removeprefix("\ufeff") if first else ""
    found = [name.strip().lower() for name in next(_csv.reader([line]), [])]
    if found != RAW_COLUMNS[table]:
        raise ValueError(
            f"{table}: header order differs from the declared columns; "
            f"found {found}, expected {RAW_COLUMNS[table]}"
        )


def read_raw_csv(
    spark: SparkSession, table: str, path: str, *, multi_line: bool = False
) -> DataFrame:
    """One raw table from CSV: every column text, empty means NULL.

    The first file's header is checked here; Spark checks each file's again while reading
    (``enforceSchema=False``). Files are split over tasks at line ends, so a record is one line; a quoted
    line break makes a record with missing columns, which fails the read instead of being misread.
    ``multi_line`` allows such breaks but reads a file in one task: give those loads many files.
    """
    check_header(spark, table, path)
    return (
        spark.read.schema(raw_schema(table))
        .option("header", True)
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )


def csv_source(spark: SparkSession, paths: dict[str, str], *, multi_line: bool = False) -> FrameSource:
    """All four raw tables from CSV paths keyed by table name."""
    return FrameSource(
        {t: read_raw_csv(spark, t, paths[t], multi_line=multi_line) for t in RAW_COLUMNS}, assembled=True
    )
