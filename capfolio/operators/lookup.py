"""Dataset freshness, agencies and read-only ad hoc SQL."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from capfolio.functions.text import contains_text
from capfolio.operators.dimensions import dataset_freshness
from capfolio.sources.schemas import DATASETS

DATA_DATES = ("fms_data_date", "agency_data_date")


def dataset_info(tables, rows_updated_at: dict[str, int] | None = None) -> DataFrame:
    """One freshness row per dataset: the stored ones of a published snapshot, else computed from the raw tables.

    Data dates exist only in the detail table.
    """
    if tables.has_built("meta"):
        return tables["meta"].drop("ingest_completed_at", "column_hash", "schema_version").orderBy("dataset_id")
    stamps = rows_updated_at or {}
    parts = []
    for d in DATASETS:
        dates = DATA_DATES if d.table == "raw_project_detail" else ()
        raw = tables.raw(d.table, (d.period_column, *dates))
        fresh = dataset_freshness(raw, d.period_column, *dates)
        shown = [F.col(c) if c in dates else F.lit(None).cast("string").alias(c) for c in DATA_DATES]
        parts.append(
            fresh.select(
                F.lit(d.dataset_id).alias("dataset_id"),
                F.lit(d.period_column).alias("period_column"),
                "row_count",
                "latest_reporting_period",
                F.lit(stamps.get(d.dataset_id)).cast("bigint").alias("rows_updated_at"),
                *shown,
            )
        )
    return reduce(DataFrame.unionByName, parts).orderBy("dataset_id")


def list_agencies(tables, contains: str | None = None) -> DataFrame:
    """The agency dimension, busiest first, optionally by text in name or slug."""
    rows = tables["agency_dim"]
    if contains:
        rows = rows.where(
            contains_text(F.col("display_name"), contains) | contains_text(F.col("slug"), contains)
        )
    return rows.orderBy(F.desc("row_count_live"), "slug")


@dataclass(frozen=True)
class AdhocResult:
    rows: list[Row]
    truncated: bool
    latest_reporting_period: str | None
    note: str | None = None


# Tables without a period column: their rows stand for the whole history.
ALL_HISTORY = ("fms_location", "fms_sponsor", "lifetime_budget_variance")
ALL_HISTORY_NOTE = "holds every period's lines, also those absent from the newest one"


def tables_named(query: str, names) -> list[str]:
    """Those of ``names`` that occur as a word in the text, in any case. One too many, as in a comment, does no harm."""
    words = {w.lower() for w in re.findall(r"\w+", query)}
    return [name for name in names if name in words]


def adhoc(tables, query: str) -> DataFrame:
    """An ad hoc query over this object's tables.

    It is placed inside a subquery, where Spark's parser accepts nothing but a query; the line break keeps a
    trailing comment from swallowing the closing parenthesis. It runs in a session of its own, whose temporary views are
    the tables it names, so nothing of another dataset is seen and no view stays behind, and files cannot be read by
    path. What else a session may do is for the cluster's own permissions: the text is not inspected.
    """
    session = tables.spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    wanted = tables_named(query, tables.names())
    suffix = uuid4().hex
    views = {name: f"{name}_{suffix}" for name in wanted}
    for name in wanted:
        tables.view(name).createOrReplaceGlobalTempView(views[name])
    try:
        for name, view in views.items():
            session.table(f"global_temp.{view}").createOrReplaceTempView(name)
        return session.sql(f"SELECT * FROM (\n{query.strip().rstrip(';')}\n) AS adhoc")
    finally:
        for view in views.values():
            tables.spark.catalog.dropGlobalTempView(view)


def run_sql(tables, query: str, row_cap: int = 100) -> AdhocResult:
    """The first ``row_cap`` rows of an ad hoc query, for display, and whether there are more; ``adhoc`` has them all."""
    fetched = adhoc(tables, query).limit(row_cap + 1).collect()
    newest = dataset_info(tables).agg(F.max("latest_reporting_period")).first()[0]
    history = tables_named(query, ALL_HISTORY)
    note = f"{', '.join(history)} {ALL_HISTORY_NOTE}" if history else None
    return AdhocResult(fetched[:row_cap], len(fetched) > row_cap, newest, note)
