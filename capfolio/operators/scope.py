"""Agency names to row filters, by the role the agency plays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capfolio.functions.text import owned_by, same_text

ROLES = ("auto", "sponsor", "managing")
ENTITIES = ("schedule", "budget")


@dataclass(frozen=True)
class AgencyNames:
    slug: str
    acronym: str | None
    variants: tuple[str, ...]
    role_default: str


@dataclass(frozen=True)
class AgencyScope:
    """A resolved agency, role and side. ``apply`` keeps the rows in scope."""

    acronym: str
    role: str
    entity: str
    variants: tuple[str, ...]
    owners: DataFrame | None

    def apply(self, frame: DataFrame) -> DataFrame:
        if self.role == "managing":
            return frame.where(F.col("managing_agency").isin(*self.variants))
        if self.entity == "schedule":
            return frame.where(owned_by(F.col("sponsor_agency"), list(self.variants)))
        # A line is kept once however many of its owners match: semi-join, never a join.
        mine = self.owners.where(F.col("sponsor_agency").isin(*self.variants)).select("fms_id")
        return frame.join(mine, "fms_id", "left_semi")


def resolve_agency(tables, name: str) -> AgencyNames | None:
    """Match on slug, acronym or any alias, ignoring case.

    Where several entries share a name, one with an acronym wins, then the lesser slug.
    Only the single winning dictionary row comes to the driver.
    """
    hit = (
        tables["agencies"]
        .where(
            same_text(F.col("slug"), name)
            | same_text(F.coalesce("cpdw_acronym", F.lit("")), name)
            | F.exists("aliases", lambda alias: same_text(alias, name))
        )
        .orderBy(F.col("cpdw_acronym").isNull(), "slug")
        .limit(1)
        .collect()
    )
    if not hit:
        return None
    row = hit[0]
    labels = {row["cpdw_acronym"], *(row["aliases"] or ())}
    return AgencyNames(
        row["slug"],
        row["cpdw_acronym"],
        tuple(sorted(v for v in labels if v)),
        row["role_default"] or "sponsor",
    )


def resolve_scope(tables, agency: str, role: str = "auto", entity: str = "schedule") -> AgencyScope:
    if role not in ROLES:
        raise ValueError(f"agency_role must be one of {ROLES}, got {role!r}")
    if entity not in ENTITIES:
        raise ValueError(f"entity must be one of {ENTITIES}, got {entity!r}")
    names = resolve_agency(tables, agency)
    if names is None:
        raise ValueError(f"unknown agency {agency!r}")
    if not names.acronym:
        raise ValueError(f"{agency!r} has no capital projects")
    lens = names.role_default if role == "auto" else role
    crosses = entity == "budget" and lens == "sponsor"
    owners = tables["fms_sponsor"] if crosses else None
    return AgencyScope(names.acronym, lens, entity, names.variants, owners)


def scoped(tables, frame: DataFrame, agency: str | None, role: str, entity: str) -> DataFrame:
    """``frame`` limited to the agency, or as it is when no agency is given."""
    if not agency:
        return frame
    return resolve_scope(tables, agency, role, entity).apply(frame)


def one_of(label: str, value, allowed) -> None:
    if value not in allowed:
        raise ValueError(f"{label} must be one of {sorted(allowed)}, got {value!r}")
