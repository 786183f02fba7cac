"""Life of an import: list, withdraw, archive, discard, delete, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civigrade.operators.joins import lookup

STATUSES = ("draft", "analyzing", "needs_review", "approved", "archived")
MATRIX_CODE = "^(eco|pes|gov|mob|amb|qvi|idd)[0-9]{2}_"


def list_imports(imports: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """Newest imports first; discarded ones are hidden unless a known status is asked for."""
    if limit < 1:
        raise ValueError("a page needs a positive limit")
    wanted = F.col("status") == status if status in STATUSES else F.col("status") != "discarded"
    return imports.filter(wanted).orderBy(F.col("created_at").desc(), "import_id").limit(limit)


def supersede_import(facts: DataFrame, imports: DataFrame, import_ids: list[str], now: Column) -> DataFrame:
    """Mark all active rows of approved imports superseded."""
    approved = imports.filter(F.col("import_id").isin(*import_ids) & (F.col("status") == "approved")).select(
        "import_id", F.lit(True).alias("_gone")
    )
    marked = facts.join(lookup(approved), "import_id", "left")
    gone = F.col("_gone").isNotNull() & F.col("superseded_at").isNull()
    return marked.withColumn("superseded_at", F.when(gone, now).otherwise(F.col("superseded_at"))).select(*facts.columns)


def unapprove(imports: DataFrame, import_ids: list[str]) -> DataFrame:
    """Approved imports go back to review; others stay as they are."""
    back = F.col("import_id").isin(*import_ids) & (F.col("status") == "approved")
    return imports.withColumn("approved_at", F.when(~back, F.col("approved_at"))).withColumn(
        "status", F.when(back, F.lit("needs_review")).otherwise(F.col("status"))
    )


def withdrawn_counts(facts: DataFrame, imports: DataFrame, import_ids: list[str]) -> DataFrame:
    """Active rows per approved import that a withdrawal would supersede."""
    approved = imports.filter(F.col("import_id").isin(*import_ids) & (F.col("status") == "approved")).select("import_id")
    active = facts.filter(F.col("superseded_at").isNull()).groupBy("import_id").agg(F.count(F.lit(1)).alias("n"))
    return approved.join(active, "import_id", "left").select("import_id", F.coalesce("n", F.lit(0).cast("long")).alias("superseded_rows"))


def archive(imports: DataFrame, import_ids: list[str], now: Column) -> DataFrame:
    """Archive imports; discarded ones are refused, archived ones keep their date."""
    go = F.col("import_id").isin(*import_ids) & ~F.col("status").isin("discarded", "archived")
    return imports.withColumn("archived_at", F.when(go, now).otherwise(F.col("archived_at"))).withColumn(
        "status", F.when(go, F.lit("archived")).otherwise(F.col("status"))
    )


def discard(imports: DataFrame, import_ids: list[str]) -> DataFrame:
    go = F.col("import_id").isin(*import_ids)
    return imports.withColumn("status", F.when(go, F.lit("discarded")).otherwise(F.col("status")))


def check_delete(imports: DataFrame, import_ids: list[str], force: bool = False) -> DataFrame:
    """Imports that must not be deleted: approved ones, unless forced."""
    return imports.filter(F.col("import_id").isin(*import_ids) & (F.col("status") == "approved") & F.lit(not force))


def delete_cascade(tables: dict[str, DataFrame], imports: DataFrame, sources: DataFrame, import_ids: list[str]):
    """All tables without the rows of the imports; a source goes when no other import uses it.

    Returns ``(tables, imports, sources, counts)``; counts has one row per table.
    """
    gone = F.col("import_id").isin(*import_ids)
    kept = {name: df.filter(~gone) for name, df in tables.items()}
    remaining = imports.filter(~gone)
    used_by_gone = imports.filter(gone).select("source_id").distinct()
    unused = used_by_gone.join(remaining.select("source_id").distinct(), "source_id", "left_anti")
    kept_sources = sources.join(unused, "source_id", "left_anti")
    counts = [df.filter(gone).agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(n)) for n, df in tables.items()]
    counts.append(imports.filter(gone).agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit("imports")))
    counts.append(sources.join(unused, "source_id", "left_semi").agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit("sources")))
    return kept, remaining, kept_sources, _union(counts).select("table", "rows")


def impact(tables: dict[str, DataFrame], imports: DataFrame) -> DataFrame:
    """Exact number of rows every import has in each table."""
    parts = [
        df.groupBy("import_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name))
        for name, df in tables.items()
    ]
    counted = _union(parts).groupBy("import_id").pivot("table", list(tables)).agg(F.sum("rows"))
    joined = imports.select("import_id", "title", "status").join(counted, "import_id", "left")
    return joined.na.fill(0, list(tables))


def deactivate_legacy(indicators: DataFrame, published: DataFrame) -> DataFrame:
    """Switch off active indicators outside the matrix codes that have no active published value."""
    used = published.filter(F.col("superseded_at").isNull()).select("indicator_code").distinct().withColumn("_used", F.lit(True))
    joined = indicators.join(used, "indicator_code", "left")
    off = F.col("active") & ~F.col("indicator_code").rlike(MATRIX_CODE) & F.col("_used").isNull()
    return joined.withColumn("active", F.col("active") & ~off).select(*indicators.columns)


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
