"""Scores of the composite index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper limits of the maturity levels and of the city profiles.
MATURITY_LEVELS = (
    (20, "Nível 1 - Inicial"),
    (40, "Nível 2 - Em desenvolvimento"),
    (60, "Nível 3 - Estruturado"),
    (80, "Nível 4 - Gerenciado"),
    (100, "Nível 5 - Otimizado"),
)
PROFILE_LIMITS = (("pequeno", 50_000), ("medio", 300_000), ("grande", 1_000_000))
LARGEST_PROFILE = "metropole"
PROFILES = tuple(name for name, _ in PROFILE_LIMITS) + (LARGEST_PROFILE,)
DIRECTIONS = ("direct", "inverse", "checklist")


def _percent(value: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), value * 100))


def indicator_score(value: Column, direction: Column, minimum: Column, maximum: Column, checklist_max: Column) -> Column:
    """Score 0-100 of a value: share of the checklist, or position in the benchmark range.

    A checklist without maximum, a missing or inverted range and any other direction have no score.
    """
    value, minimum, maximum, full = (c.cast("double") for c in (value, minimum, maximum, checklist_max))
    span = maximum - minimum
    usable = value.isNotNull() & (minimum < maximum)
    return (
        F.when((direction == "checklist") & (full != 0) & value.isNotNull(), _percent(F.try_divide(value, full)))
        .when(usable & (direction == "direct"), _percent(F.try_divide(value - minimum, span)))
        .when(usable & (direction == "inverse"), _percent(F.try_divide(maximum - value, span)))
    )


def maturity(score: Column) -> Column:
    """Label of the first level whose limit is not below the score."""
    label = F.lit(None).cast("string")
    for limit, name in reversed(MATURITY_LEVELS):
        label = F.when(score <= limit, F.lit(name)).otherwise(label)
    return label


def city_profile(inhabitants: Column) -> Column:
    """Size class of a municipality; null without a population."""
    profile = F.lit(LARGEST_PROFILE)
    for name, limit in reversed(PROFILE_LIMITS):
        profile = F.when(inhabitants <= limit, F.lit(name)).otherwise(profile)
    return F.when(inhabitants > 0, profile)
