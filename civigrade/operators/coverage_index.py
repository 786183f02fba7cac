"""Coverage that follows imports: bitmaps of municipality numbers per import and indicator.

Every municipality code gets a number once, in the order codes turn up, and keeps it. Per import, indicator and bucket of 32,768 numbers
one row is kept: a bitmap of the municipalities, the number of rows, and the first and last period. Bitmaps merge by OR, so coverage of
any choice of imports is read from their rows alone: withdrawing an import takes its rows away, and nothing is counted again.

``numbers``    number of each code, dealt by code
``summaries``  the bitmaps, dealt by import: adding or withdrawing an import reads and writes the slots of that import only

Defined results: a row without a municipality is a value but no municipality; a null import or indicator is one like any other; an
import that is put in again is replaced; repeating a change commits nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from civigrade.operators.joins import lookup
from civigrade.operators.ledger import SLOTS, Ledger
from civigrade.session import materialise

NUMBERS = "municipality_ibge_code string, number long"
SUMMARIES = "import_id string, indicator_code string, bucket long, places binary, rows long, first_period date, last_period date"


@dataclass(frozen=True)
class CoverageIndex:
    numbers: Ledger
    summaries: Ledger


def coverage_at(spark: SparkSession, root: str, slots: int = SLOTS) -> CoverageIndex:
    """The index below ``root``; it is empty as long as nothing was put in."""
    numbers = Ledger(spark, f"{root}/numbers", StructType.fromDDL(NUMBERS), ("municipality_ibge_code",), ("number",), slots)
    return CoverageIndex(numbers, Ledger(spark, f"{root}/summaries", StructType.fromDDL(SUMMARIES), ("import_id",), ("import_id", "indicator_code", "bucket"), slots))


def number_codes(index: CoverageIndex, codes: DataFrame) -> int | None:
    """Give every code that has none the next numbers; the commit, or None if all were known."""
    base = index.numbers.head()
    known = index.numbers.read(upto=base)
    start = (known.agg(F.max("number")).first()[0] or 0) + 1
    fresh = codes.filter("municipality_ibge_code IS NOT NULL").select("municipality_ibge_code").distinct()
    fresh = materialise(fresh.join(known, "municipality_ibge_code", "left_anti"), "codes")
    numbered = materialise(fresh.withColumn("number", F.monotonically_increasing_id() + start), "numbers")
    touched = index.numbers.slots_of(numbered)
    return index.numbers.write(index.numbers.read(touched, base).unionByName(numbered), touched, base) if touched else None


def summarised(index: CoverageIndex, rows: DataFrame) -> DataFrame:
    """Bitmaps, counts and periods per import, indicator and bucket of the serving rows ``rows``."""
    key = ["import_id", "indicator_code"]
    period = F.col("reference_period").cast("date")
    # One row for each municipality first, so a large indicator is spread over all tasks.
    places = rows.groupBy(*key, "municipality_ibge_code").agg(F.count(F.lit(1)).alias("rows"), F.min(period).alias("first_period"), F.max(period).alias("last_period"))
    numbered = places.join(lookup(index.numbers.read()), "municipality_ibge_code", "left")
    return numbered.groupBy(*key, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("places"),
        F.sum("rows").alias("rows"),
        F.min("first_period").alias("first_period"),
        F.max("last_period").alias("last_period"),
    )


def _of(imports: DataFrame, rows: DataFrame) -> Column:
    return rows["import_id"].eqNullSafe(imports["import_id"])


def put(index: CoverageIndex, rows: DataFrame) -> int | None:
    """Put in the serving rows of one or more imports (import_id, indicator_code, municipality_ibge_code, reference_period), whole."""
    base = index.summaries.head()
    number_codes(index, rows)
    own = materialise(summarised(index, rows), "summaries")
    imports = lookup(own.select("import_id").distinct())
    touched = index.summaries.slots_of(imports)
    if not touched:
        return None
    before = index.summaries.read(touched, base)
    return index.summaries.write(before.join(imports, _of(imports, before), "left_anti").unionByName(own), touched, base)


def withdraw(index: CoverageIndex, imports: DataFrame) -> int | None:
    """Take the imports (``import_id``, a small table) away."""
    base, imports = index.summaries.head(), lookup(imports.select("import_id").distinct())
    touched = index.summaries.slots_of(imports)
    if not touched:
        return None
    before = index.summaries.read(touched, base)
    return index.summaries.write(before.join(imports, _of(imports, before), "left_anti"), touched, base)


def kept(index: CoverageIndex, imports: DataFrame | None = None) -> DataFrame:
    """The summaries of all imports, or of a choice of them (``import_id``): only their slots are read."""
    if imports is None:
        return index.summaries.read()
    imports = lookup(imports.select("import_id").distinct())
    rows = index.summaries.read(index.summaries.slots_of(imports))
    return rows.join(imports, _of(imports, rows), "left_semi")


def indicator_coverage(index: CoverageIndex, imports: DataFrame | None = None) -> DataFrame:
    """``coverage.indicator_coverage`` of all imports or of a choice, from the bitmaps alone."""
    return merged(kept(index, imports))


def merged(summaries: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Municipalities, values, first and last period per indicator (and ``group``) of summaries of any imports."""
    periods = [F.min("first_period").alias("first_period"), F.max("last_period").alias("last_period")]
    buckets = summaries.groupBy(*group, "indicator_code", "bucket").agg(F.bitmap_or_agg("places").alias("places"), F.sum("rows").alias("rows"), *periods)
    municipalities = F.sum(F.bitmap_count("places")).alias("municipalities")
    return buckets.groupBy(*group, "indicator_code").agg(municipalities, F.sum("rows").alias("value_count"), *periods)


def impact(index: CoverageIndex, imports: DataFrame) -> DataFrame:
    """Rows and indicators of each of ``imports``, from its summaries; an import without rows has none of both."""
    asked = imports.select("import_id").distinct()
    held = kept(index, asked).groupBy("import_id", "indicator_code").agg(F.sum("rows").alias("rows"))
    found = held.groupBy(F.col("import_id").alias("of_import")).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("indicators"))
    none = F.lit(0).cast("long")
    joined = asked.join(found, F.col("import_id").eqNullSafe(F.col("of_import")), "left")
    return joined.select("import_id", F.coalesce("rows", none).alias("rows"), F.coalesce("indicators", none).alias("indicators"))
