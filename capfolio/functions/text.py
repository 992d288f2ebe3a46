"""Literal text matching and comma-joined owner strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_text(column: Column, text: str) -> Column:
    """Case-insensitive equality."""
    return F.lower(column) == F.lower(F.lit(text))


def contains_text(column: Column, text: str) -> Column:
    """Case-insensitive substring test; '%' and '_' have no special meaning."""
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lower(F.lit(text)))


def owner_atoms(owners: Column) -> Column:
    """Array of single owners from a comma-joined string (blank pieces may remain)."""
    return F.split(F.trim(owners), " *, *")


def owned_by(owners: Column, names: list[str]) -> Column:
    """True where any single owner in the comma-joined string is one of ``names``."""
    return F.arrays_overlap(owner_atoms(owners), F.array(*[F.lit(n) for n in names]))
