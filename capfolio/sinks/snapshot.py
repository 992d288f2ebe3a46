"""Publish every table as a snapshot that readers see whole or not at all.

Layout under the base folder: tables by period lie in ``data/<table>/<period>/build=<id>``, the others in
``snapshot=<id>/<table>``; ``manifest`` has one row per table and snapshot. Files are never changed. A snapshot writes the periods
whose raw rows changed and refers to earlier builds of all others, so an older snapshot stays what it was. The manifest rows
of a snapshot are written last, in one file, so a build that fails leaves files nobody reads, and the previous
snapshot stays in use.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capfolio.operators.lookup import dataset_info
from capfolio.plans.tables import ANALYTIC, NORMALIZED, PERIOD_GRAIN, Tables
from capfolio.sources.dictionaries import DEFAULT_TAXONOMY, Agency, Taxonomy
from capfolio.sources.raw import FrameSource, period_column
from capfolio.sources.schemas import DATASETS, RAW_COLUMNS

_MANIFEST = pa.schema(
    [
        ("snapshot", pa.string()), ("table", pa.string()), ("path", pa.string()), ("layout", pa.string()),
        ("published_at", pa.int64()), ("newest_period", pa.string()), ("column_hash", pa.string()),
        ("schema_version", pa.int32()), ("builds", pa.string()),
    ]
)
# Raised when published tables change in a way that older readers would misread.
SCHEMA_VERSION = 2
# The raw tables whose rows of a period decide a table's rows of that period.
SAME_PERIOD = {
    "schedule_budget_link": ("raw_project_detail",),
    "schedule_history": ("raw_project_detail", "raw_schedule_history"),
    "budget_history": ("raw_budget_history",),
    "project_budget_fy": ("raw_budget_fy",),
}


def new_snapshot_id() -> str:
    """Sorts by time; the suffix keeps two builds in one second apart."""
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid4().hex[:6]}"


def column_hash(columns: Iterable[str]) -> str:
    """Digest of column names in order; tells whether a snapshot has the raw layout that this code declares."""
    return hashlib.sha256("\n".join(columns).encode()).hexdigest()


@dataclass(frozen=True)
class Periods:
    """The folder (below the table's own) and, for raw tables, the content digest of each period of a table."""

    column: str
    builds: dict[str | None, str]
    digests: dict[str | None, str]

    def to_json(self) -> str:
        rows = [[p, self.builds.get(p), self.digests.get(p)] for p in {**self.builds, **self.digests}]
        return json.dumps([self.column, rows])

    @classmethod
    def from_json(cls, text: str) -> Periods:
        column, rows = json.loads(text)
        return cls(column, {p: b for p, b, _ in rows if b}, {p: d for p, _, d in rows if d})


def content_digests(frame: DataFrame, period: str) -> dict[str | None, str]:
    """A digest of each period's rows, whatever their order: their number, and the sum and the XOR of their hashes.

    One scan with a map-side combined aggregate; the result has a row per period.
    """
    row = F.xxhash64(*[c for part in frame.columns for c in (F.col(part), F.col(part).isNull())])
    found = frame.groupBy(F.col(period).alias("period")).agg(
        F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("total"), F.bit_xor(row).alias("mix")
    )
    return {r.period: f"{r.n}:{r.total}:{r.mix}" for r in found.collect()}


def of_periods(frame: DataFrame, column: str, periods: Iterable[str | None]) -> DataFrame:
    wanted = [p for p in periods if p is not None]
    keep = F.col(column).isin(*wanted) if wanted else F.lit(False)
    return frame.where(F.coalesce(keep, F.lit(None in periods)))


def _with_build(layout: T.StructType) -> T.StructType:
    return T.StructType([*layout.fields, T.StructField("build", T.StringType())])


def _write_periods(frame: DataFrame, folder: str, column: str, build: str) -> dict[str | None, str]:
    """The frame's periods as a build of their own; gives the folder of each.

    The rebalance evens out file sizes within a period: small pieces merge, and a period
    far above the rest is split over several tasks.
    """
    rows = frame.withColumn("build", F.lit(build)).hint("rebalance", column)
    rows.write.mode("append").partitionBy(column, "build").parquet(folder)
    files = frame.sparkSession.read.schema(_with_build(frame.schema)).parquet(folder).where(F.col("build") == build)
    found = files.select(column, "_metadata.file_path").groupBy(column).agg(F.min("file_path").alias("path")).collect()
    return {r[0]: "/".join(r.path.split("/")[-3:-1]) for r in found}


def _open_periods(spark: SparkSession, folder: str, layout: T.StructType, periods: Periods) -> DataFrame:
    """The folders that a snapshot refers to, and no others."""
    if not periods.builds:
        return spark.createDataFrame([], layout)
    # With its layout given, a period's value is not read as a number.
    reader = spark.read.schema(_with_build(layout)).option("basePath", folder)
    return reader.parquet(*[f"{folder}/{path}" for path in periods.builds.values()]).select(*layout.names)


def _open(spark: SparkSession, path: str, layout: T.StructType) -> DataFrame:
    return spark.read.schema(layout).parquet(path).select(*layout.names)


def publish(
    tables: Tables,
    base: str,
    snapshot: str | None = None,
    rows_updated_at: dict[str, int] | None = None,
) -> str:
    """Build everything in dependency order, each table from the files of those before it.

    Raw rows are compared with the snapshot published last by a digest of each period. Of raw tables and of tables by
    period only the periods that differ are written; tables over all history are built anew from the files.
    """
    spark, snapshot = tables.spark, snapshot or new_snapshot_id()
    base = base.rstrip("/")
    folder = f"{base}/snapshot={snapshot}"
    before = _earlier_periods(spark, base)
    written: dict[str, DataFrame] = {}
    periods: dict[str, Periods] = {}
    paths: dict[str, str] = {}
    if snapshot in _snapshots(spark, base):
        raise ValueError(f"snapshot {snapshot!r} is published already")

    def keep(name: str, frame: DataFrame) -> None:
        paths[name] = f"{folder}/{name}"
        frame.write.parquet(paths[name])
        written[name] = _open(spark, paths[name], frame.schema)

    def keep_periods(name: str, changed: DataFrame, column: str, fresh: set, present: Iterable, digests: dict) -> None:
        old = before.get(name)
        builds = {p: old.builds[p] for p in present if old and p not in fresh and p in old.builds}
        paths[name] = f"{base}/data/{name}"
        if fresh:
            builds |= _write_periods(changed, paths[name], column, snapshot)
        periods[name] = Periods(column, builds, digests)
        written[name] = _open_periods(spark, paths[name], changed.schema, periods[name])

    fresh: dict[str, set] = {}
    for name, columns in RAW_COLUMNS.items():
        column, frame = period_column(name), tables.raw(name, columns)
        digests = content_digests(frame, column)
        known = before[name].digests if name in before else {}
        fresh[name] = {p for p, d in digests.items() if known.get(p) != d}
        keep_periods(name, of_periods(frame, column, fresh[name]), column, fresh[name], digests, digests)
    raw = {name: written[name] for name in RAW_COLUMNS}

    staged = tables.over(FrameSource(raw))
    for name in NORMALIZED:
        if name not in SAME_PERIOD:
            keep(name, staged[name])
        else:
            sources = SAME_PERIOD[name]
            # A period that a source has lost counts as changed.
            lost = {p for t in sources if t in before for p in before[t].builds if p not in periods[t].builds}
            new = set.union(lost, *[fresh[t] for t in sources])
            present = sorted({p for t in sources for p in periods[t].builds if p is not None})
            part = tables.over(FrameSource({t: of_periods(f, period_column(t), new) for t, f in raw.items()}))
            keep_periods(name, part[name], "reporting_period", new, present, {})
        staged.use(name, written[name])
    for name in ANALYTIC:
        keep(name, staged[name])
        staged.use(name, written[name])
    layout = F.create_map(*[F.lit(x) for d in DATASETS for x in (d.dataset_id, column_hash(RAW_COLUMNS[d.table]))])
    keep("meta", dataset_info(staged, rows_updated_at).select(
        "*",
        F.current_timestamp().alias("ingest_completed_at"),
        layout[F.col("dataset_id")].alias("column_hash"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
    ))
    newest = {n: written[n].agg(F.max("reporting_period")).first()[0] for n in PERIOD_GRAIN}
    published_at = time.time_ns() // 1000

    rows = [
        {
            "snapshot": snapshot, "table": n, "path": paths[n], "layout": f.schema.json(),
            "published_at": published_at, "newest_period": newest.get(n), "column_hash": column_hash(f.columns),
            "schema_version": SCHEMA_VERSION, "builds": periods[n].to_json() if n in periods else None,
        }
        for n, f in written.items()
    ]
    manifest = spark.createDataFrame(pa.Table.from_pylist(rows, schema=_MANIFEST))
    manifest.coalesce(1).write.mode("append").parquet(f"{base}/manifest")
    return snapshot


def _manifest(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(
        "snapshot string, `table` string, path string, layout string, published_at bigint, newest_period string, "
        "column_hash string, schema_version int, builds string"
    ).parquet(f"{base.rstrip('/')}/manifest")


def _last_published(manifest: DataFrame) -> str | None:
    latest = manifest.orderBy(F.desc_nulls_last("published_at"), F.desc("snapshot")).select("snapshot").first()
    return latest["snapshot"] if latest else None


def _snapshots(spark: SparkSession, base: str) -> set[str]:
    try:
        return {r.snapshot for r in _manifest(spark, base).select("snapshot").distinct().collect()}
    except AnalysisException:  # nothing published yet
        return set()


def _earlier_periods(spark: SparkSession, base: str) -> dict[str, Periods]:
    """The builds and digests of the snapshot published last, of tables whose columns are still the same."""
    if not _snapshots(spark, base):
        return {}
    manifest = _manifest(spark, base)
    rows = manifest.where((F.col("snapshot") == _last_published(manifest)) & F.col("builds").isNotNull()).collect()
    usable = all(
        r["schema_version"] == SCHEMA_VERSION and r["column_hash"] == column_hash(RAW_COLUMNS[r["table"]])
        for r in rows if r["table"] in RAW_COLUMNS
    )
    return {r["table"]: Periods.from_json(r["builds"]) for r in rows} if usable else {}


def open_published(
    spark: SparkSession,
    base: str,
    agencies: Iterable[Agency] = (),
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
    snapshot: str | None = None,
) -> Tables:
    """The snapshot published last (or a given one) as tables.

    ValueError if there is none, or if it was written with another raw layout or schema version.
    """
    manifest = _manifest(spark, base)
    if snapshot is None:
        snapshot = _last_published(manifest)
    entries = manifest.where(F.col("snapshot") == snapshot).collect()
    if not entries:
        raise ValueError(f"no complete snapshot {snapshot!r} under {base}")
    hashes = {e["table"]: e["column_hash"] for e in entries}
    other = [t for t, columns in RAW_COLUMNS.items() if hashes.get(t) != column_hash(columns)]
    if other or any(e["schema_version"] != SCHEMA_VERSION for e in entries):
        raise ValueError(f"snapshot {snapshot!r} has another layout: {', '.join(other) or 'schema version'}")
    opened = {}
    for e in entries:
        shape = T.StructType.fromJson(json.loads(e["layout"]))
        opened[e["table"]] = (
            _open_periods(spark, e["path"], shape, Periods.from_json(e["builds"])) if e["builds"] else _open(spark, e["path"], shape)
        )
    raw = FrameSource({name: opened.pop(name) for name in RAW_COLUMNS})
    newest = {e["table"]: e["newest_period"] for e in entries if e["table"] in PERIOD_GRAIN}
    return Tables(spark, raw, agencies, taxonomy, built=opened, newest_periods=newest)
