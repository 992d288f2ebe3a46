"""Text-to-typed casts that give NULL for what is not a value.

Spark and the SQL dialect whose results are matched disagree on a few spellings;
each helper says which and settles it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money is added up as DECIMAL so that totals do not depend on row order; 22 integer
# digits and 6 decimals leave room for sums far beyond any budget.
MONEY = "decimal(28,6)"


def to_double(text: Column) -> Column:
    """DOUBLE or NULL. Spark also reads a Java type suffix ('7d', '7f'): NULL here."""
    suffix = F.rtrim(text).substr(-1, 1)
    return F.when(~suffix.isin("d", "D", "f", "F"), text.try_cast("double"))


def to_long(text: Column) -> Column:
    """BIGINT or NULL. A decimal text is rounded ('45.6' is 46); Spark alone gives NULL."""
    return F.coalesce(text.try_cast("bigint"), F.round(to_double(text)).try_cast("bigint"))


def to_int(text: Column) -> Column:
    return to_long(text).try_cast("int")


def to_date(text: Column) -> Column:
    """DATE or NULL. Spark also reads '2026' and '2026-01'; a full date is required here.

    In ``yyyy-m-d`` the second hyphen is at position 7 or 8.
    """
    second_hyphen = F.locate("-", F.ltrim(text), 7)
    return F.when(second_hyphen > 0, text.try_cast("date"))


def exact_money(amount: Column) -> Column:
    """The amount as DECIMAL, NULL where that type cannot hold it (NaN, infinity, 1e22 and beyond)."""
    return amount.try_cast(MONEY)


def beyond_money(amount: Column) -> Column:
    """The amount where ``exact_money`` cannot hold it, else NULL."""
    return F.when(exact_money(amount).isNull(), amount)


def money_total(exact: Column, beyond: Column) -> Column:
    """Both parts of a sum as one DOUBLE; NULL only if neither has a value."""
    return F.when(beyond.isNull(), exact.cast("double")).otherwise(
        F.coalesce(exact.cast("double"), F.lit(0.0)) + beyond
    )


def money_sum(amount: Column) -> Column:
    """Sum of a DOUBLE money column, as DOUBLE.

    Amounts that DECIMAL holds are summed exactly, so row order does not matter; all others are summed as DOUBLE and
    added, so that no amount is lost and NaN stays NaN.
    """
    return money_total(F.sum(exact_money(amount)), F.sum(beyond_money(amount)))
