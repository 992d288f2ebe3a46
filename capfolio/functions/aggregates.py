"""Aggregates that pick a value by the order of another column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_at_latest(value: Column, order: Column) -> Column:
    """The non-NULL ``value`` at the greatest ``order``; the greater value on a tie.

    A max over a struct combines on the map side, so a hot group never lands whole in
    one task, and the tie rule makes the result independent of row order.
    """
    pair = F.struct(order.alias("o"), value.alias("v"))
    return F.max(F.when(order.isNotNull() & value.isNotNull(), pair))["v"]


def value_at_earliest(value: Column, order: Column) -> Column:
    """The non-NULL ``value`` at the least ``order``; the lesser value on a tie."""
    pair = F.struct(order.alias("o"), value.alias("v"))
    return F.min(F.when(order.isNotNull() & value.isNotNull(), pair))["v"]
