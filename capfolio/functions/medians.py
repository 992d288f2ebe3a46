"""Exact medians of whole numbers, selected in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from capfolio.functions.joins import join_many_to_one

# Values whose quotient by 2 ** BAND_BITS is equal share a band.
BAND_BITS = 8


def histogram(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys``, ``value`` as BIGINT and ``n``: how many rows agree in both. A hot group is spread by its values."""
    return rows.groupBy(*keys, F.col(value).cast("bigint").alias(value)).agg(F.count("*").alias("n"))


def exact_medians(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys`` and ``median`` of each group of a ``histogram``; NULL values do not count.

    Counts are first added up by bands of values. Running totals over a group's bands say which one or two bands hold the middle;
    only their values are ordered. So no task sees all distinct values of a group, however many rows it has: bands are a
    256th of the value range, and a band has 256 values at most.
    """
    known = counts.where(F.col(value).isNotNull()).withColumn("_band", F.shiftright(value, BAND_BITS))
    group = W.partitionBy(*keys)
    upto = group.orderBy("_band").rowsBetween(W.unboundedPreceding, W.currentRow)
    bands = known.groupBy(*keys, "_band").agg(F.sum("n").alias("_n")).select(
        *keys, "_band", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(upto).alias("_upto"),
        F.floor((F.sum("_n").over(group) - 1) / 2).alias("_low"), F.floor(F.sum("_n").over(group) / 2).alias("_high"),
    )
    middle = bands.where((F.col("_before") <= F.col("_high")) & (F.col("_upto") > F.col("_low"))).drop("_upto")
    inside = W.partitionBy(*keys, "_band").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = join_many_to_one(known, middle, [*keys, "_band"], null_matches=True)
    placed = near.withColumn("_upto", F.col("_before") + F.sum("n").over(inside))
    chosen = placed.where((F.col("_upto") - F.col("n") <= F.col("_high")) & (F.col("_upto") > F.col("_low")))
    ends = [F.min(value).cast("double"), F.max(value).cast("double")]
    return chosen.groupBy(*keys).agg(((ends[0] + ends[1]) / 2).alias("median"))


def with_medians(groups: DataFrame, counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``groups`` (one row per value of ``keys``) with ``median``, NULL where a group has no value."""
    medians = exact_medians(counts, keys, value)
    if not keys:
        return groups.withColumn("median", medians.scalar())
    return join_many_to_one(groups, medians, keys, "left", null_matches=True)
