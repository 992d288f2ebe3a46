"""Joins from a side with hot keys to a side with one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_many_to_one(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    null_matches: bool = False,
) -> DataFrame:
    """Join ``many`` to ``one`` so that a key holding much of ``many`` can be split.

    ``one`` usually comes from an aggregate on the same keys. A plain equi-join would reuse
    the aggregate's partitioning, and adaptive execution splits a hot partition only when
    both inputs are shuffles of their own. Null-safe equality hashes a different expression,
    so both sides get that shuffle; the additional one moves only the small, one-row-per-key
    side. Below the broadcast threshold, which Spark checks against measured sizes, no
    shuffle happens at all.

    NULL keys match only if ``null_matches``.
    """
    side = one if null_matches else one.dropna(subset=list(keys))
    if not null_matches and how in ("inner", "left_semi"):
        # Rows without a key cannot match; dropped here, they are not all shuffled to one partition.
        many = many.dropna(subset=list(keys))
    side = side.withColumnsRenamed({k: f"one_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"one_{k}")) for k in keys]
    joined = many.join(side, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"one_{k}" for k in keys])
