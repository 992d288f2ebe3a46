"""Dimensions: budget-line category, agency, and dataset freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capfolio.functions.aggregates import value_at_latest
from capfolio.functions.periods import latest_full_period
from capfolio.sources.dictionaries import Category, Taxonomy

DETAIL_CATEGORY_INPUT = (
    "reporting_period", "fms_id", "managing_agency", "sponsor_agency", "ten_year_plan_category",
)
BUDGET_CATEGORY_INPUT = ("year_month_reported", "fms_id", "managing_agency")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _first_match(pairs: list[tuple[Column, str]]) -> Column:
    """Name of the first pair whose test holds, else NULL."""
    result = F.lit(None).cast("string")
    for test, name in reversed(pairs):
        result = F.when(test, F.lit(name)).otherwise(result)
    return result


def _text_tests(rule: Category, plan_text: Column, line: Column, ever: Column | None) -> list[Column]:
    tests = [ever] if ever is not None else []
    tests += [F.startswith(F.lower(line), F.lit(p.lower())) for p in rule.prefixes]
    tests += [F.contains(F.lower(plan_text), F.lit(k.lower())) for k in rule.keywords]
    return tests


def category_of(
    taxonomy: Taxonomy, plan_text: Column, line: Column, sponsor: Column, ever: dict[str, Column]
) -> Column:
    """Category of one line: specific text rules, then sponsor, then generic text, else other.

    A composite sponsor such as 'A, B' equals no single name and so matches nothing.
    """
    by_text = [
        (rule, _any(tests))
        for rule in taxonomy.categories
        if (tests := _text_tests(rule, plan_text, line, ever.get(rule.name)))
    ]
    specific = [(test, rule.name) for rule, test in by_text if not rule.generic]
    generic = [(test, rule.name) for rule, test in by_text if rule.generic]
    owner = [(sponsor.isin(*r.sponsors), r.name) for r in taxonomy.categories if r.sponsors]
    return F.coalesce(
        _first_match(specific), _first_match(owner), _first_match(generic), F.lit(taxonomy.other_label)
    )


def category_dim(detail: DataFrame, history: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """One category per line id, from all periods of both tables.

    Both tables feed one aggregate over their union, so a line id is shuffled once, after
    map-side combining.
    """
    owners = [c for c in taxonomy.categories if c.ever_managed_by]
    absent = F.lit(None).cast("string")
    rows = detail.select(
        "fms_id",
        F.col("reporting_period").alias("period"),
        F.col("ten_year_plan_category").alias("plan_text"),
        F.col("sponsor_agency").alias("sponsor"),
        absent.alias("holder"),
        F.col("managing_agency").alias("manager"),
    ).unionByName(
        history.select(
            "fms_id",
            F.col("year_month_reported").alias("period"),
            absent.alias("plan_text"),
            absent.alias("sponsor"),
            F.col("managing_agency").alias("holder"),
            F.col("managing_agency").alias("manager"),
        )
    )
    ever = [
        F.bool_or(
            F.coalesce(F.col("manager").isin(*c.ever_managed_by), F.lit(False))
            | F.coalesce(F.col("sponsor").isin(*c.ever_managed_by), F.lit(False))
        ).alias(f"ever_{i}")
        for i, c in enumerate(owners)
    ]
    lines = (
        rows.where(F.col("fms_id").isNotNull())
        .groupBy("fms_id")
        .agg(
            value_at_latest(F.col("plan_text"), F.col("period")).alias("plan_text"),
            value_at_latest(F.col("sponsor"), F.col("period")).alias("sponsor"),
            value_at_latest(F.col("holder"), F.col("period")).alias("holder"),
            *ever,
        )
    )
    return lines.select(
        "fms_id",
        category_of(
            taxonomy,
            plan_text=F.col("plan_text"),
            line=F.col("fms_id"),
            sponsor=F.coalesce("sponsor", "holder"),
            ever={c.name: F.col(f"ever_{i}") for i, c in enumerate(owners)},
        ).alias("category"),
    )


def agency_dim(agencies: DataFrame, detail: DataFrame) -> DataFrame:
    """The agency dictionary with live presence and row counts.

    ``cpd_active`` is SQL's three-valued membership test: unknown for a missing acronym,
    and unknown rather than false while the data holds a row without an agency.
    """
    counts = detail.groupBy("managing_agency").agg(F.count("*").alias("n"))
    live = counts.where(F.col("managing_agency").isNotNull())
    seen = counts.agg(
        F.count("*").alias("groups"),
        F.count_if(F.col("managing_agency").isNull()).alias("nameless"),
    )
    groups, nameless = seen.select("groups").scalar(), seen.select("nameless").scalar()
    unknown = (groups > 0) & (F.col("cpdw_acronym").isNull() | (nameless > 0))
    active = F.when(F.col("n").isNotNull(), True).when(~unknown, False)
    return agencies.join(live, agencies["cpdw_acronym"] == live["managing_agency"], "left").select(
        "slug", "display_name", "aliases", "cpdw_acronym",
        active.alias("cpd_active"),
        "is_schedule_executor",
        F.coalesce("n", F.lit(0)).alias("row_count_live"),
        "role_default",
    )


def period_counts(raw: DataFrame, period: str, *maxima: str) -> DataFrame:
    """Rows per period of a raw table, with the greatest value of each ``maxima`` column."""
    return raw.groupBy(F.col(period).alias("period")).agg(
        F.count("*").alias("n"), *[F.max(c).alias(c) for c in maxima]
    )


def dataset_freshness(raw: DataFrame, period: str, *maxima: str) -> DataFrame:
    """One row: rows, latest full period and the data dates found there."""
    return latest_full_period(period_counts(raw, period, *maxima), *maxima)
