"""The lazy table graph: raw source -> normalized -> analytic -> dimension tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capfolio.functions.periods import in_cadence
from capfolio.operators import derive, dimensions, normalize
from capfolio.sources.dictionaries import DEFAULT_TAXONOMY, Agency, Taxonomy, agency_frame
from capfolio.sinks.staging import stage_all
from capfolio.sources.raw import FrameSource, RawSource, StagedSource, period_column
from capfolio.sources.schemas import RAW_COLUMNS

# Tables built from the source and what each one reads. Order is build order.
NORMALIZED = (
    "schedule_budget_link", "schedule_history", "budget_history", "original_budget",
    "project_budget_fy",
)
ANALYTIC = (
    "pid_links", "pid_funding", "latest_project_state", "fms_location",
    "cumulative_schedule_variance", "lifetime_budget_variance", "agency_rollup_by_period",
    "fms_sponsor", "category_dim", "agency_dim",
)
PERIOD_GRAIN = ("schedule_budget_link", "schedule_history", "budget_history", "project_budget_fy")


@dataclass(frozen=True)
class RawNeed:
    """The columns and rows of a raw table that a derived table reads."""

    table: str
    columns: tuple[str, ...]
    not_null: tuple[str, ...] = ()
    is_null: tuple[str, ...] = ()
    in_cadence: bool = False


# What each derived table reads of the raw tables, and how often of other derived tables. Order is build order.
RAW_NEEDS: dict[str, tuple[RawNeed, ...]] = {
    "link_edges": (RawNeed("raw_project_detail", normalize.EDGE_INPUT, ("pid", "fms_id"), in_cadence=True),),
    "schedule_spine": (RawNeed("raw_project_detail", normalize.SPINE_INPUT, ("pid",), in_cadence=True),),
    "schedule_variance": (RawNeed("raw_schedule_history", normalize.VARIANCE_INPUT, ("pid",)),),
    "budget_history": (RawNeed("raw_budget_history", normalize.SNAPSHOT_INPUT, ("spend_to_date",)),),
    "original_budget": (RawNeed("raw_budget_history", normalize.ADOPTED_INPUT, is_null=("spend_to_date",)),),
    "project_budget_fy": (RawNeed("raw_budget_fy", normalize.FISCAL_INPUT),),
    "fms_location": (RawNeed("raw_project_detail", derive.LOCATION_INPUT, ("fms_id",), in_cadence=True),),
    "category_dim": (
        RawNeed("raw_project_detail", dimensions.DETAIL_CATEGORY_INPUT, ("fms_id",)),
        RawNeed("raw_budget_history", dimensions.BUDGET_CATEGORY_INPUT, ("fms_id",)),
    ),
    "agency_dim": (RawNeed("raw_project_detail", ("managing_agency",)),),
}
TABLE_NEEDS: dict[str, dict[str, int]] = {
    "schedule_budget_link": {"link_edges": 3},
    "pid_links": {"link_edges": 2},
    "pid_funding": {"pid_links": 1},
    "schedule_history": {"schedule_spine": 1, "schedule_variance": 1},
    "latest_project_state": {"schedule_history": 1, "pid_funding": 1},
    "cumulative_schedule_variance": {"schedule_history": 1},
    "lifetime_budget_variance": {"budget_history": 1, "original_budget": 1},
    "agency_rollup_by_period": {"schedule_history": 1, "budget_history": 1},
    "fms_sponsor": {"latest_project_state": 1, "pid_links": 1},
}
BUILD_ORDER = (
    "link_edges", "schedule_spine", "schedule_variance", "budget_history", "original_budget", "category_dim",
    "fms_location", "schedule_history", "pid_links", "pid_funding", "latest_project_state", "lifetime_budget_variance",
    "fms_sponsor",
)
# Tables that can be limited to some columns, and what is then made for them alone, with less in it.
LIMITED = {
    "latest_project_state": ("schedule_spine", "schedule_history"),
    "lifetime_budget_variance": ("budget_history", "original_budget"),
}


def tables_of(name: str, columns: Mapping[str, Sequence[str]]) -> dict[str, int]:
    """The derived tables that a table reads, where of some tables only ``columns`` are wanted."""
    found = TABLE_NEEDS.get(name, {})
    for limited, below, made in (
        ("latest_project_state", "pid_funding", derive.FUNDING_COLUMNS),
        ("lifetime_budget_variance", "original_budget", derive.ADOPTED_COLUMNS),
    ):
        if name == limited in columns and not set(made) & set(columns[limited]):
            found = {t: n for t, n in found.items() if t != below}
    return found


def needs_of(name: str, columns: Mapping[str, Sequence[str]]) -> tuple[RawNeed, ...]:
    """The raw columns and rows that a table reads, where of some tables only ``columns`` are wanted."""
    found = RAW_NEEDS.get(name, ())
    if name == "schedule_spine" and "latest_project_state" in columns:
        read = {"pid", "reporting_period"}.union(*[derive.STATE_INPUT.get(c, ()) for c in columns["latest_project_state"]])
    elif name == "budget_history" and "lifetime_budget_variance" in columns:
        read = {"managing_agency", "fms_id", "year_month_reported", "total_budget", "spend_to_date"}
        read |= {derive.LAST_MEASURES[m][0] for m in derive.last_measures(columns["lifetime_budget_variance"])}
    else:
        return found
    return tuple(replace(n, columns=tuple(c for c in n.columns if c in read)) for n in found)


class Tables:
    """Tables by name, each planned on first use and built only when something reads it.

    ``built`` maps names to already materialized DataFrames (a published snapshot); those
    are read instead of being planned again. ``newest_periods`` are the greatest periods such a
    snapshot has recorded for them.
    """

    def __init__(
        self,
        spark: SparkSession,
        source: RawSource,
        agencies: Iterable[Agency] = (),
        taxonomy: Taxonomy = DEFAULT_TAXONOMY,
        built: dict[str, DataFrame] | None = None,
        newest_periods: dict[str, str | None] | None = None,
    ):
        self.spark = spark
        self.source = source
        self.taxonomy = taxonomy
        self._agencies = tuple(agencies)
        self._built = dict(built or {})
        self._newest_periods = dict(newest_periods or {})
        self._planned: dict[str, DataFrame] = {}
        self._columns: dict[str, Sequence[str]] = {}
        self._current: DataFrame | None = None
        self._building = 0

    def raw(
        self,
        table: str,
        columns: Sequence[str],
        not_null: Sequence[str] = (),
        is_null: Sequence[str] = (),
    ) -> DataFrame:
        return self.source.read(table, columns, not_null, is_null)

    def _repeats(self, table: str) -> bool:
        """Whether the records of a raw table may share their key."""
        return table not in self.source.without_repeats

    def _raw_of(self, name: str, current: bool = False) -> list[DataFrame]:
        """The raw frames that a derived table is built from. Columns that nobody reads (see ``sharing``) are NULL.

        With ``current``, details of older periods may be missing.
        """
        source = FrameSource({"raw_project_detail": self._current}) if current and self._current is not None else self.source
        frames = []
        for full, need in zip(RAW_NEEDS[name], needs_of(name, self._columns), strict=True):
            frame = source.read(need.table, need.columns, need.not_null, need.is_null)
            unread = [c for c in full.columns if c not in need.columns]
            frames.append(frame.withColumns({c: F.lit(None).cast("string") for c in unread}) if unread else frame)
        return frames

    def reads(
        self, uses: Mapping[str, int], columns: Mapping[str, Sequence[str]] | None = None
    ) -> tuple[dict[str, list[RawNeed]], Counter]:
        """What building ``uses`` (table: times it is read) reads: the needs by raw table, and how often each derived one.

        A derived table that is read several times counts as built once, which is what ``sharing`` makes of it.
        """
        columns = columns or {}
        times: Counter = Counter()

        def visit(name: str, n: int) -> None:
            if name in self._built:
                return
            first = not times[name]
            times[name] += n
            if first:
                for below, m in tables_of(name, columns).items():
                    visit(below, m)

        for name, n in uses.items():
            visit(name, n)
        needs: dict[str, list[RawNeed]] = {}
        for name in times:
            for need in needs_of(name, columns):
                needs.setdefault(need.table, []).append(need)
        return needs, times

    def sharing(
        self,
        uses: Mapping[str, int],
        columns: Mapping[str, Sequence[str]] | None = None,
        rows: Mapping[str, Column] | None = None,
        current: bool = False,
    ) -> Tables:
        """Tables for an operator that reads ``uses`` (table: times), in which nothing is derived twice.

        ``columns`` names, for a table, the only columns that the operator reads. Of a latest state or lifetime budgets that
        are limited so, and that alone read the tables they are made of, nothing else is derived, nor read of the raw tables.

        A raw table that has to be put together (joined or parsed) and that several derived tables read is staged, with the
        union of their columns and the conditions that all of them have; then each derived table that is read several
        times. These writes are jobs that run now. Published tables and raw tables that are files already are read as they are.

        ``rows`` gives, for further tables, the condition on the only rows of them that the operator reads. These few rows are
        staged first, each table by itself: it may read other raw columns and rows than all others, which a common copy of the
        raw table would have to hold.

        ``current`` says that the latest state and the current links are read and, beside them, no edges but ``edge_rows``: the
        stored details are then cut to the newest periods once, in a copy for both.
        """
        apart = {name: self[name].where(kept) for name, kept in (rows or {}).items() if name not in self._built}
        few = stage_all(apart)
        limits = {name: held for name, held in (columns or {}).items() if self._reads_alone(name, uses)}
        needs, times = self.reads(uses, limits)
        shared = {t: found for t, found in needs.items() if len(found) > 1} if self.source.assembled else {}
        frames = {}
        for table, found in shared.items():
            wanted = {c for n in found for c in (*n.columns, *n.not_null, *n.is_null)}
            common = [set.intersection(*[set(getattr(n, kind)) for n in found]) for kind in ("not_null", "is_null")]
            held = [c for c in RAW_COLUMNS[table] if c in wanted]
            frame = self.raw(table, held, *[[c for c in held if c in these] for these in common])
            frames[table] = frame.where(in_cadence(F.col(period_column(table)))) if all(n.in_cadence for n in found) else frame
        source = StagedSource(self.source, stage_all(frames)) if frames else self.source
        staged = Tables(self.spark, source, self._agencies, self.taxonomy, self._built, self._newest_periods)
        staged._built |= few
        staged._columns = limits
        staged._current = staged._current_details(times) if current else None
        for name in BUILD_ORDER:
            if times[name] > 1 and not (name == "link_edges" and staged._current is not None):
                wanted = (columns or {}).get(name, staged[name].columns)
                staged.use(name, stage_all({name: staged[name].select(*wanted)})[name])
        return staged

    def _current_details(self, times: Mapping[str, int]) -> DataFrame | None:
        """The details of the newest periods, stored, where the latest state and the current links are made of a stored copy."""
        if not (times["latest_project_state"] and times["pid_links"] and isinstance(self.source, StagedSource)):
            return None
        if times["schedule_history"] > 1 or any(t in self._built for t in ("schedule_spine", "schedule_history", "link_edges", "schedule_budget_link")):
            return None
        wanted = {c for name in ("schedule_spine", "link_edges") for n in needs_of(name, self._columns) for c in n.columns}
        held = [c for c in RAW_COLUMNS["raw_project_detail"] if c in wanted]
        details = self.raw("raw_project_detail", held, ("pid",))
        return stage_all({"current": normalize.current_details(details)})["current"]

    def _reads_alone(self, name: str, uses: Mapping[str, int]) -> bool:
        """Whether no other used table is made of ``name`` or of what it is made of by ``LIMITED``."""
        others = self.reads({used: n for used, n in uses.items() if used != name})[1]
        return name in LIMITED and name not in self._built and not any(others[t] or t in self._built for t in (name, *LIMITED[name]))

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._built:
            return self._built[name]
        if any(name in LIMITED[limited] for limited in self._columns) and not self._building:
            raise KeyError(f"{name} holds only what another table reads of it")
        if name not in self._planned:
            build = getattr(self, f"_build_{name}", None)
            if build is None:
                raise KeyError(name)
            self._building += 1
            try:
                made = build()
            finally:
                self._building -= 1
            self._planned[name] = made.select(*self._columns[name]) if name in self._columns else made
        return self._planned[name]

    def use(self, name: str, frame: DataFrame) -> None:
        """Read ``name`` from ``frame`` from now on, also for tables planned before."""
        self._built[name] = frame
        self._planned.clear()

    def over(self, source: RawSource) -> Tables:
        """The same dictionaries over another source, with nothing built yet."""
        return Tables(self.spark, source, self._agencies, self.taxonomy)

    def period(self, table: str, period: str = "current") -> Column:
        """A period as a Column: the given text, or the newest one in the table.

        The newest is a scalar subquery, so it stays in the plan, costs one narrow scan
        and filters the source before any join.
        """
        if period != "current":
            return F.lit(period)
        if table in self._newest_periods:
            return F.lit(self._newest_periods[table]).cast("string")
        if table in self._built:
            newest = self._built[table].agg(F.max("reporting_period"))
        elif table == "schedule_history":
            newest = self.source.latest_cadence_period("raw_project_detail", ("pid",))
        else:
            newest = self.source.latest_cadence_period("raw_budget_history", ("spend_to_date",))
        return newest.scalar()

    def has_schedules(self, period: str) -> bool:
        """Whether any schedule was reported in the period; stops at the first row found."""
        if "schedule_history" in self._built:
            rows = self._built["schedule_history"]
        else:
            rows = self.raw("raw_project_detail", ("reporting_period",), ("pid",))
        return not rows.where(F.col("reporting_period") == period).isEmpty()

    def edge_rows(self, current: bool = False) -> DataFrame:
        """The rows of ``link_edges``, repeats included unless it is kept already: for readers to whom repeats do not matter.

        With ``current``, links of older periods may be missing.
        """
        if {"link_edges", "schedule_budget_link"} & self._built.keys():
            return self["link_edges"]
        return normalize.edge_rows(*self._raw_of("link_edges", current))

    def names(self) -> tuple[str, ...]:
        """Every raw and derived table by name."""
        return (*RAW_COLUMNS, *NORMALIZED, *ANALYTIC)

    def view(self, name: str) -> DataFrame:
        """A raw or derived table with all its columns."""
        return self.raw(name, RAW_COLUMNS[name]) if name in RAW_COLUMNS else self[name]

    def has_built(self, name: str) -> bool:
        return name in self._built

    # -- normalized ---------------------------------------------------------------

    def _build_link_edges(self) -> DataFrame:
        if "schedule_budget_link" in self._built:
            return self._built["schedule_budget_link"].drop("n_budgets_for_pid", "n_pids_for_budget")
        return normalize.link_edges(*self._raw_of("link_edges"))

    def _build_schedule_budget_link(self) -> DataFrame:
        return normalize.schedule_budget_link(self["link_edges"])

    def _build_schedule_spine(self) -> DataFrame:
        return normalize.schedule_spine(*self._raw_of("schedule_spine"))

    def _build_schedule_variance(self) -> DataFrame:
        return normalize.schedule_variance(*self._raw_of("schedule_variance"), self._repeats("raw_schedule_history"))

    def _build_schedule_history(self) -> DataFrame:
        return normalize.schedule_history(self["schedule_spine"], self["schedule_variance"])

    def _build_budget_history(self) -> DataFrame:
        return normalize.budget_history(*self._raw_of("budget_history"), self._repeats("raw_budget_history"))

    def _build_original_budget(self) -> DataFrame:
        return normalize.original_budget(*self._raw_of("original_budget"))

    def _build_project_budget_fy(self) -> DataFrame:
        return normalize.project_budget_fy(*self._raw_of("project_budget_fy"))

    # -- analytic -----------------------------------------------------------------

    def _build_pid_links(self) -> DataFrame:
        return derive.pid_links(self.edge_rows(current=True))

    def _build_pid_funding(self) -> DataFrame:
        return derive.pid_funding(self["pid_links"])

    def _build_latest_project_state(self) -> DataFrame:
        if {"schedule_history", "schedule_spine"} & self._built.keys():
            newest = derive.latest_snapshot(self["schedule_history"].select("pid", "reporting_period", *derive.STATE_COLUMNS))
        else:
            spine = normalize.schedule_spine(normalize.newest_reports(*self._raw_of("schedule_spine", current=True)))
            newest = normalize.schedule_history(spine, self["schedule_variance"])
        return derive.latest_project_state(newest, self["pid_funding"])

    def _build_fms_location(self) -> DataFrame:
        return derive.fms_location(*self._raw_of("fms_location"))

    def _build_cumulative_schedule_variance(self) -> DataFrame:
        return derive.cumulative_schedule_variance(self["schedule_history"])

    def _build_lifetime_budget_variance(self) -> DataFrame:
        columns = self._columns.get("lifetime_budget_variance")
        return derive.lifetime_budget_variance(self["budget_history"], self["original_budget"], columns)

    def _build_agency_rollup_by_period(self) -> DataFrame:
        return derive.agency_rollup_by_period(self["schedule_history"], self["budget_history"])

    def _build_fms_sponsor(self) -> DataFrame:
        return derive.fms_sponsor(self["latest_project_state"], self["pid_links"])

    # -- dimensions ---------------------------------------------------------------

    def _build_category_dim(self) -> DataFrame:
        return dimensions.category_dim(*self._raw_of("category_dim"), self.taxonomy)

    def _build_agencies(self) -> DataFrame:
        return agency_frame(self.spark, self._agencies)

    def _build_agency_dim(self) -> DataFrame:
        return dimensions.agency_dim(self["agencies"], *self._raw_of("agency_dim"))
