"""Approval and publication as changes of ledgers: only the slots of the imports and indicators approved are read and rewritten.

The rules are those of ``publication``. What differs is that an observation the approval finds again just as it was stays active
instead of being superseded by a copy of itself, so approving the same rows twice commits nothing the second time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civigrade.operators import publication
from civigrade.operators.joins import lookup
from civigrade.operators.ledger import SLOTS, Ledger, create
from civigrade.operators.publication import OBSERVATION_KEY, SCOPE, FieldNames
from civigrade.session import materialise

BY = ("import_id", "indicator_code")
#: What makes two observations the same.
SAME = [*OBSERVATION_KEY, "reference_year", "value", "unit", "source_sheet", "source_row_number", "is_monthly"]


@dataclass(frozen=True)
class Committed:
    """The commits an approval made (None: nothing to change), the slots it looked at, and the candidates it judged."""

    candidates: DataFrame
    slots: list[int]
    observations: int | None
    issues: int | None


def observation_ledger(rows: DataFrame, root: str, slots: int = SLOTS) -> Ledger:
    return create(rows, root, BY, ("municipality_code", "reference_period"), slots)


def issue_ledger(rows: DataFrame, root: str, slots: int = SLOTS) -> Ledger:
    return create(rows, root, BY, ("row_number", "field"), slots)


def published_ledger(rows: DataFrame, root: str, slots: int = SLOTS) -> Ledger:
    return create(rows, root, BY, ("municipality_ibge_code", "reference_period"), slots)


def _same(left: str, right: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in SAME])


def observations_after(before: DataFrame, fresh: DataFrame, scope: DataFrame, now: Column) -> DataFrame:
    """``before`` with the accepted rows ``fresh`` of an approval; rows that come again as they were stay as they are."""
    flagged = before.withColumn("_active", F.col("superseded_at").isNull())
    marked = publication.supersede_scope(flagged, scope, now).withColumn("_gone", F.col("_active") & F.col("superseded_at").isNotNull())
    again = fresh.select(*SAME, F.lit(True).alias("_again"))
    met = marked.alias("m").join(again.alias("f"), F.col("m._gone") & _same("m", "f"), "left")
    stays = F.when(F.col("m._gone") & F.col("f._again"), F.lit(None)).otherwise(F.col("m.superseded_at")).alias("superseded_at")
    kept = met.select(*[stays if c == "superseded_at" else F.col(f"m.{c}") for c in before.columns])
    added = fresh.alias("f").join(marked.filter("_gone").alias("m"), _same("f", "m"), "left_anti")
    return kept.unionByName(added.select(*before.columns))


def approve(
    candidates: DataFrame, observations: Ledger, issues: Ledger, now: Column, scope: DataFrame, fields: FieldNames = FieldNames(), by_sheet: bool = False
) -> Committed:
    """Approve the candidates of ``scope`` (imports, indicators and sheets; a small table).

    Issues are committed before observations: a run that ends between the two is completed by running it again.
    """
    scope = lookup(scope.select(*SCOPE).distinct())
    touched = observations.slots_of(scope)
    if touched != issues.slots_of(scope):
        raise ValueError("observations and issues must be dealt to the same slots")
    bases = observations.head(), issues.head()
    candidates = materialise(candidates.join(scope, reduce(Column.__and__, [candidates[c].eqNullSafe(scope[c]) for c in SCOPE]), "left_semi"), "candidates")
    before = observations.read(touched, bases[0])
    marked = materialise(publication.mark(candidates, publication.supersede_scope(before, scope, now), by_sheet), "marked")
    told = publication.refresh_issues(issues.read(touched, bases[1]), publication.issues_of(marked, fields), scope, fields)
    issue_commit = issues.write(told, touched, bases[1])
    after = observations_after(before, publication.accepted(marked), scope, now)
    return Committed(marked, touched, observations.write(after, touched, bases[0]), issue_commit)


def sync(published: Ledger, observations: Ledger, imports: DataFrame, indicators: DataFrame, now: Column, since: int) -> int | None:
    """Bring published values up to date with what was committed to the observations after commit ``since``."""
    if (published.slots, published.by) != (observations.slots, observations.by):
        raise ValueError("published values and observations must be dealt to the same slots")
    touched = observations.changed_since(since)
    if not touched:
        return None
    base = published.head()
    rows = publication.sync_published(published.read(touched, base), observations.read(touched), imports, indicators, now)
    return published.write(rows, touched, base)
