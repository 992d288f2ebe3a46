"""Curated dictionaries: agencies and category rules.

Both are small hand-kept files. The agency dictionary is always the caller's own; the
category taxonomy has a default below.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Agencies that run schedules.
SCHEDULE_EXECUTORS = frozenset(
    ["DDC", "EDC", "DEP", "DOT", "DPR", "DOC", "CUNY", "NYPD", "FDNY", "DCAS", "DHS", "DOHMH", "DSNY"]
)

_AGENCY_LAYOUT = pa.schema(
    [
        ("slug", pa.string()),
        ("display_name", pa.string()),
        ("aliases", pa.list_(pa.string())),
        ("cpdw_acronym", pa.string()),
        ("is_schedule_executor", pa.bool_()),
        ("role_default", pa.string()),
    ]
)


@dataclass(frozen=True)
class Agency:
    slug: str
    display_name: str
    aliases: tuple[str, ...] = ()
    cpdw_acronym: str | None = None
    is_schedule_executor: bool = False
    role_default: str = "sponsor"


@dataclass(frozen=True)
class Category:
    name: str
    keywords: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    ever_managed_by: tuple[str, ...] = ()
    sponsors: tuple[str, ...] = ()
    generic: bool = False


@dataclass(frozen=True)
class Taxonomy:
    categories: tuple[Category, ...]
    other_label: str = "Other / Uncategorized"
    names: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        names = tuple(c.name for c in self.categories) + (self.other_label,)
        object.__setattr__(self, "names", names)


def _load(path: str | Path) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("YAML dictionaries need PyYAML; a .json file works without") from missing
    return yaml.safe_load(text) or {}


def load_agencies(path: str | Path) -> list[Agency]:
    """Agency entries keyed by slug: ``display``, ``aliases``, ``cpdw_acronym``, ``role_default``."""
    entries = [(slug, e) for slug, e in _load(path).items() if isinstance(e, dict)]
    return [
        Agency(
            slug=slug,
            display_name=e.get("display", slug),
            aliases=tuple(e.get("aliases") or ()),
            cpdw_acronym=e.get("cpdw_acronym"),
            is_schedule_executor=e.get("cpdw_acronym") in SCHEDULE_EXECUTORS,
            role_default=e.get("role_default", "sponsor"),
        )
        for slug, e in entries
    ]


def load_taxonomy(path: str | Path) -> Taxonomy:
    """Category rules in file order plus the label for everything else."""
    doc = _load(path)
    rules = tuple(
        Category(
            name=c["name"],
            keywords=tuple(c.get("ten_year_any") or ()),
            prefixes=tuple(c.get("fms_prefix") or ()),
            ever_managed_by=tuple(c.get("ever_managed_by") or ()),
            sponsors=tuple(c.get("sponsor_agencies") or ()),
            generic=bool(c.get("generic")),
        )
        for c in doc.get("categories") or ()
    )
    return Taxonomy(rules, doc.get("other_label", Taxonomy.other_label))


def agency_frame(spark: SparkSession, agencies: Iterable[Agency]) -> DataFrame:
    """The dictionary as a local relation, so Spark knows its exact (small) size."""
    rows = [
        {name: list(v) if isinstance(v := getattr(a, name), tuple) else v for name in _AGENCY_LAYOUT.names}
        for a in agencies
    ]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=_AGENCY_LAYOUT))


# The default program/facility taxonomy. Order matters within each tier.
DEFAULT_TAXONOMY = Taxonomy(
    (
        Category(
            "Library",
            prefixes=("LB", "LN", "LQ"),
            ever_managed_by=("BPL", "NYPL", "QPL", "NYRL"),
            sponsors=("BPL", "NYPL", "QPL", "NYRL"),
        ),
        Category("Bridges", keywords=("bridge",), prefixes=("HB", "BR")),
        Category(
            "Parks & Recreation",
            keywords=("park", "playground", "ballfield", "zoos", "recreational facilities"),
            sponsors=("DPR",),
        ),
        Category(
            "Ferries & Waterfront", keywords=("ferry", "waterfront", "port develop"), prefixes=("FA",)
        ),
        Category(
            "Streets & Highways",
            keywords=(
                "street", "resurfac", "pedestrian ramp", "sidewalk", "pavement", "lamppost",
                "luminaire", "signal", "traffic", "highway", "retaining wall",
            ),
            sponsors=("DOT",),
        ),
        Category(
            "Sewer & Water",
            keywords=(
                "water", "sewer", "bluebelt", "plant upgrad", "plant component", "filter",
                "filtration", "tunnel", "dam safety", "distribution main", "nutrient",
                "consent decree", "utility relocation",
            ),
            prefixes=("WP", "WM", "SE", "EP", "PS", "OB", "PR"),
            sponsors=("DEP",),
        ),
        Category("Police", keywords=("police",), prefixes=("PO",), sponsors=("NYPD",)),
        Category("Jails & Correction", keywords=("jail", "correction"), sponsors=("DOC",)),
        Category("Courts", keywords=("court",)),
        Category("Homeless Shelters", keywords=("shelter", "homeless"), sponsors=("DHS",)),
        Category(
            "Health & Hospitals",
            keywords=("hospital", "clinic", "medical", "ocme", "animal care"),
            sponsors=("DOHMH", "HHC"),
        ),
        Category("Schools & Education", keywords=("school",), sponsors=("DOE", "SCA", "CUNY")),
        Category(
            "Cultural Institutions",
            keywords=("cultural", "museum"),
            ever_managed_by=("DCLA",),
            sponsors=("DCLA",),
        ),
        Category("Housing", keywords=("housing",), sponsors=("HPD",)),
        Category(
            "Social Services",
            keywords=("child welfare", "social service", "aging"),
            sponsors=("HRA", "ACS", "DFTA"),
        ),
        Category(
            "Economic Development",
            keywords=(
                "industrial", "commercial", "market develop", "neighborhood revitaliz",
                "rail develop", "community develop",
            ),
            sponsors=("EDC",),
        ),
        Category("Sanitation", keywords=("garage", "solid waste"), sponsors=("DSNY",)),
        Category(
            "Energy & Sustainability",
            keywords=("energy", "sustainab", "distributed generation", "electrical distribution"),
        ),
        Category(
            "Technology & Equipment",
            keywords=(
                "data processing", "information technolog", "information system", "equipment",
                "surveillance", "election",
            ),
        ),
        Category("Fire & EMS", sponsors=("FDNY",)),
        Category(
            "City Buildings & Facilities",
            keywords=("office space", "leased space", "city-owned", "facilit", "building"),
            sponsors=("DCAS",),
            generic=True,
        ),
    )
)
