"""Neutral wording for signed values and for link fan-out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (positive, negative) wording by kind; zero is 'unchanged' in both.
DIRECTIONS = {"schedule": ("later", "earlier"), "budget": ("increased", "decreased")}


def direction(value: Column, kind: str = "schedule") -> Column:
    up, down = DIRECTIONS[kind]
    return F.when(value > 0, up).when(value < 0, down).when(value == 0, "unchanged")


def link_caveat(n: Column, anchor: str) -> Column:
    """Reading advice by number of counterparts: none, one (1:1), or a fan-out."""
    other = {"schedule": "budget lines", "budget": "schedules"}[anchor]
    fan_out = F.concat(
        F.lit("many-to-many: "), n.cast("string"), F.lit(f" linked {other}; report all of them")
    )
    return (
        F.when(n == 0, f"no linked {other} at the latest link period")
        .when(n == 1, f"1:1 with its counterpart among the {other}")
        .otherwise(fan_out)
    )
