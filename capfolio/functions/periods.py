"""Reporting periods: text ``YYYYMM``, so text order is time order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Months with a published snapshot, and the share of the median row
# count a period needs to count as fully published.
CADENCE_MONTHS = ("01", "05", "09")
FULL_PERIOD_SHARE = 0.5

_CADENCE_PATTERN = "^[0-9]{4}(" + "|".join(CADENCE_MONTHS) + ")$"


def in_cadence(period: Column) -> Column:
    """Loose test used on rows: the text ends in a cadence month."""
    return F.right(period, F.lit(2)).isin(*CADENCE_MONTHS)


def is_cadence_period(period: str | None) -> bool:
    """Strict test used on arguments: six digits ending in a cadence month."""
    return bool(period) and re.fullmatch(_CADENCE_PATTERN, period) is not None


def cadence_period(period: Column) -> Column:
    """The strict test as a Column."""
    return period.rlike(_CADENCE_PATTERN)


def latest_full_period(counts: DataFrame, *carried: str) -> DataFrame:
    """One row: total rows, latest fully published period and the ``carried`` columns there.

    ``counts`` has one row per period with columns ``period`` and ``n``. A cadence period
    is full when it holds at least half the median count. The list built here has one
    element per six-digit cadence period, so its length is bounded by the calendar.
    """
    is_full_candidate = cadence_period(F.col("period"))
    entry = F.when(is_full_candidate, F.struct("period", "n", *carried))
    pooled = counts.agg(
        F.sum("n").alias("row_count"),
        F.median(F.when(is_full_candidate, F.col("n"))).alias("typical"),
        F.collect_list(entry).alias("entries"),
    )
    threshold = F.col("typical") * FULL_PERIOD_SHARE
    best = F.array_max(F.filter("entries", lambda e: e["n"] >= threshold))
    return pooled.select(
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        best["period"].alias("latest_reporting_period"),
        *[best[c].alias(c) for c in carried],
    )
