"""Project phase text: matching key, display label and lifecycle rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The display spelling of each published phase, by matching key.
PHASE_LABELS = {
    "pre-design": "Pre-Design",
    "design": "Design",
    "construction procurement": "Construction Procurement",
    "construction": "Construction",
    "close-out": "Close-out",
    "closeout": "Close-out",
}
# Phases (and no-schedule reasons) that end a project.
COMPLETED_PHASES = ("completed", "close-out", "closeout")
CANCELLED_PHASES = ("cancelled", "terminated", "withdrawn", "defaulted")

COMPLETED_RANK, CANCELLED_RANK, OPEN_RANK = 3, 2, 1


def _bare(phase: Column) -> Column:
    return F.lower(F.trim(F.translate(phase, "()", "")))


def phase_key(phase: Column) -> Column:
    """Matching key: no parentheses, outer blanks or case, single inner blanks."""
    return F.regexp_replace(_bare(phase), r"\s+", " ")


def phase_label(phase: Column) -> Column:
    """Display spelling; anything outside the known phases keeps its own text."""
    key = phase_key(phase)
    label = F.lit(None).cast("string")
    for known, shown in PHASE_LABELS.items():
        label = F.when(key == known, F.lit(shown)).otherwise(label)
    return F.coalesce(label, phase)


def phase_rank(phase: Column) -> Column:
    """3 completed, 2 cancelled, 1 anything else (a missing phase included).

    The ranked phases are single words, so folding inner blanks could not make a match
    and this per-row test goes without the regular expression.
    """
    key = _bare(phase)
    return (
        F.when(key.isin(*COMPLETED_PHASES), COMPLETED_RANK)
        .when(key.isin(*CANCELLED_PHASES), CANCELLED_RANK)
        .otherwise(OPEN_RANK)
    )


def is_reason(phase: Column) -> Column:
    """A parenthesised entry states why there is no schedule; it is not a phase."""
    return F.startswith(phase, F.lit("("))
