"""Withdrawal and deletion of imports by tombstones: a mark per import that readers apply, and a compaction that rewrites touched slots.

All fact tables are ledgers dealt by import. Withdrawing or deleting imports writes one small row for each of them and no fact. Readers
join the facts with the marks: rows of a deleted import are gone, active rows of a withdrawn one count as superseded at the time of
the mark. ``compact`` puts the marks into the facts: of every table it reads and rewrites the slots of marked imports only, files of
other slots stay as they are, and the marks go last, so a run that ends in between is completed by running it again.

Defined results: a deletion outweighs a withdrawal and the first withdrawal keeps its time; marks of unknown imports are kept until the
next compaction and change nothing; a null import can be marked like any other; tables without ``superseded_at`` know deletion only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from civigrade.operators.joins import lookup
from civigrade.operators.ledger import SLOTS, Ledger
from civigrade.session import materialise

MARKS = "import_id string, is_deleted boolean, marked_at timestamp"
BY = ("import_id",)


@dataclass(frozen=True)
class Facts:
    tables: dict[str, Ledger]
    marks: Ledger


def facts_at(spark: SparkSession, root: str, schemas: dict[str, StructType], slots: int = SLOTS) -> Facts:
    """The fact tables of ``schemas`` (each with ``import_id``) below ``root``; they are empty as long as nothing was put in."""
    tables = {name: Ledger(spark, f"{root}/{name}", schema, BY, BY, slots) for name, schema in schemas.items()}
    return Facts(tables, Ledger(spark, f"{root}/marks", StructType.fromDDL(MARKS), BY, BY, slots))


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["import_id"].eqNullSafe(right["import_id"])


def put(facts: Facts, name: str, rows: DataFrame) -> int | None:
    """Replace the imports that ``rows`` holds in one table. Marks of these imports are put into the facts first."""
    imports = materialise(rows.select("import_id").distinct(), "imports")
    table = facts.tables[name]
    touched = table.slots_of(imports)
    if not touched:
        return None
    marks = facts.marks.read(touched)
    if not marks.join(lookup(imports), _same(marks, imports), "left_semi").isEmpty():
        compact(facts)
    base = table.head()
    before = table.read(touched, base)
    others = before.join(lookup(imports), _same(before, imports), "left_anti")
    return table.write(others.unionByName(rows.select(*table.names)), touched, base)


def mark(facts: Facts, imports: DataFrame, now: Column, delete: bool) -> int | None:
    """Mark imports (``import_id``, a small table) as withdrawn or deleted; only the slots of marks are written."""
    base = facts.marks.head()
    fresh = materialise(imports.select("import_id", F.lit(delete).alias("is_deleted"), now.alias("marked_at")).distinct(), "marks")
    touched = facts.marks.slots_of(fresh)
    if not touched:
        return None
    both = facts.marks.read(touched, base).unionByName(fresh)
    merged = both.groupBy("import_id").agg(F.bool_or("is_deleted").alias("is_deleted"), F.min("marked_at").alias("marked_at"))
    return facts.marks.write(merged, touched, base)


def withdraw(facts: Facts, imports: DataFrame, now: Column) -> int | None:
    return mark(facts, imports, now, delete=False)


def delete(facts: Facts, imports: DataFrame, now: Column) -> int | None:
    return mark(facts, imports, now, delete=True)


def read(facts: Facts, name: str, slots: list[int] | None = None) -> DataFrame:
    """The rows of a table as the marks leave them."""
    table = facts.tables[name]
    return _applied(table.read(slots), facts.marks.read(slots), table.names)


def _applied(rows: DataFrame, marks: DataFrame, names: list[str]) -> DataFrame:
    own = lookup(marks.select(F.col("import_id").alias("_import"), "is_deleted", "marked_at"))
    met = rows.join(own, F.col("import_id").eqNullSafe(F.col("_import")), "left").filter(~F.coalesce("is_deleted", F.lit(False)))
    return met.select(*[F.coalesce("superseded_at", "marked_at").alias(c) if c == "superseded_at" else F.col(c) for c in names])


def counts(facts: Facts, imports: DataFrame) -> DataFrame:
    """Stored rows and active rows of each import and table, from the slots of these imports only; marks are not applied.

    What a withdrawal would supersede (``active``) and a deletion would remove (``rows``).
    """
    imports = materialise(imports.select("import_id").distinct(), "imports")
    parts = None
    for name, table in facts.tables.items():
        rows = table.read(table.slots_of(imports))
        active = F.col("superseded_at").isNull() if "superseded_at" in table.names else F.lit(True)
        own = rows.join(lookup(imports), _same(rows, imports), "left_semi")
        part = own.groupBy("import_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(active).alias("active")).withColumn("table", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return parts.select("table", "import_id", "rows", "active")


def compact(facts: Facts) -> dict[str, int]:
    """Put all marks into the facts and drop them; the new commit of every table that changed."""
    base = facts.marks.head()
    marks = materialise(facts.marks.read(upto=base), "marks")
    touched = facts.marks.slots_of(marks)
    commits = {}
    for name, table in facts.tables.items() if touched else ():
        own = table.head()
        commit = table.write(_applied(table.read(touched, own), marks, table.names), touched, own)
        if commit is not None:
            commits[name] = commit
    if touched:
        facts.marks.write(facts.marks.read([]), touched, base)
    return commits
