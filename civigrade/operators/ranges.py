"""Benchmark ranges that follow imports: exact percentiles from mergeable histograms and the few values around each wanted rank.

Three ledgers below one root hold what ``benchmarks`` works out anew on every call:

``latest``   the latest row with a value of each indicator and municipality, dealt by both: where an import looks up what it replaces
``values``   the same values dealt by indicator and *bin*, where a rank looks up the values around it
``bins``     number and periods of the values per indicator, city profile and bin, a mergeable histogram

A bin is a monotone function of the value (about a quarter of a per cent wide), so counts of bins place every rank exactly: all values
of lower bins are below, all of higher bins above. Putting in an import reads the slots of its keys, moves the values that changed from
bin to bin, and counts the touched bins again. Ranges read all bins (bounded by indicators, profiles and bins, not by values) and of the
values only the slots of the bins that hold a wanted rank; with several times more slots than ranks most values stay unread. An
indicator whose values all fall into one bin has that bin read.

Defined results: values that are null, not finite or without a municipality count nowhere; of rows with one key the latest period and
then the least id counts, whichever import brought it and in whatever order imports came; putting rows in again changes nothing. A
municipality has the profile it was put in with: rebuild the tables when the population table changes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from civigrade.functions.scoring import city_profile
from civigrade.operators import benchmarks
from civigrade.operators.joins import latest, lookup, prefix_sums
from civigrade.operators.ledger import SLOTS, Ledger
from civigrade.session import materialise

#: Bins per unit of the natural logarithm.
BINS_PER_UNIT = 400
#: Above the bins of all logarithms of doubles, so bins of negative, zero and positive values keep apart.
POSITIVE = 1 << 20
KEY = ["indicator_code", "municipality_ibge_code"]
LATEST = "indicator_code string, municipality_ibge_code string, reference_period date, id {id_type}, value double, city_profile string, bin long"
VALUES = "indicator_code string, bin long, municipality_ibge_code string, city_profile string, value double, reference_period date"
BINS = "indicator_code string, city_profile string, bin long, n long, first_period date, last_period date"
PLACE = ["indicator_code", "bin"]
GROUP = ["indicator_code", "city_profile"]


def bin_of(value: Column) -> Column:
    """A number that never falls as the value grows: the logarithm of the size in steps, with the sign."""
    size = F.floor(F.log(F.abs(value)) * BINS_PER_UNIT) + POSITIVE
    return F.when(value == 0, 0).when(value > 0, size).otherwise(-size).cast("long")


@dataclass(frozen=True)
class Ranges:
    latest: Ledger
    values: Ledger
    bins: Ledger


def ranges_at(spark: SparkSession, root: str, slots: int = SLOTS, id_type: str = "long") -> Ranges:
    """The tables below ``root``; they are empty as long as nothing was put in. ``id_type`` is the type of the ids of published rows."""

    def book(name: str, schema: str, by: list[str], order: list[str]) -> Ledger:
        return Ledger(spark, f"{root}/{name}", StructType.fromDDL(schema), tuple(by), tuple(order), slots)

    return Ranges(book("latest", LATEST.format(id_type=id_type), KEY, KEY), book("values", VALUES, PLACE, [*PLACE, KEY[1]]), book("bins", BINS, PLACE, [*GROUP, "bin"]))


def candidates(rows: DataFrame, population: DataFrame) -> DataFrame:
    """Of each key the published row that can be its latest value, with its bin and the profile of its municipality.

    Rows of one key are reduced to one before the population is looked up. The population grows with the municipalities, so it is
    joined by shuffle unless adaptive execution finds it small; of several numbers for one municipality the largest counts.
    """
    people = population.groupBy(F.col("ibge_code").alias("municipality_ibge_code")).agg(F.max("inhabitants").alias("inhabitants"))
    value = F.col("value").cast("double")
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")) & (F.col("municipality_ibge_code") != "")
    present = rows.filter(usable & F.col("indicator_code").isNotNull()).select(
        *KEY, F.col("reference_period").cast("date").alias("reference_period"), "id", value.alias("value")
    )
    placed = latest(present, KEY, "reference_period", ["id"]).join(people, "municipality_ibge_code", "left")
    return placed.select(*KEY, "reference_period", "id", "value", city_profile(F.col("inhabitants")).alias("city_profile"), bin_of(F.col("value")).alias("bin"))


def put(tables: Ranges, rows: DataFrame, population: DataFrame) -> bool:
    """Bring the tables up to date with the published rows of an import; whether anything changed.

    ``latest`` is committed last. A run that ends before that is completed by running it again: it moves the same values and counts the
    same slots anew. Nothing else may be put in between.
    """
    bases = [book.head() for book in (tables.latest, tables.values, tables.bins)]
    fresh = materialise(candidates(rows, population), "fresh")
    slots = tables.latest.slots_of(fresh)
    if not slots:
        return False
    paired = materialise(_paired(tables, tables.latest.read(slots, bases[0]), fresh), "latest")
    after = paired.select(*tables.latest.names)
    moved, columns = paired.filter("moved"), tables.values.names
    gone, come = moved.filter("old IS NOT NULL").select("old.*"), moved.select(*columns)
    changed = gone.unionByName(come).select(*PLACE, KEY[1])
    touched = tables.values.slots_of(changed)
    if touched:
        if len(slots) == tables.latest.slots:
            # Every latest row has been read, so the new content of the slots is at hand.
            content = after.select(*columns).filter(tables.values.slot().isin(touched))
        else:
            kept = tables.values.read(touched, bases[1]).join(changed, [*PLACE, KEY[1]], "left_anti")
            content = materialise(kept.unionByName(come), "values")
        counted = content.groupBy(*GROUP, "bin").agg(
            F.count(F.lit(1)).alias("n"), F.min("reference_period").alias("first_period"), F.max("reference_period").alias("last_period")
        )
        tables.values.write(content, touched, bases[1])
        tables.bins.write(counted, touched, bases[2])
    return tables.latest.write(after, slots, bases[0]) is not None


def _paired(tables: Ranges, before: DataFrame, fresh: DataFrame) -> DataFrame:
    """The latest row of each key after an import, whether its value has ``moved``, and the value it had then (``old``, null if none).

    Both tables have at most one row for a key and no null in it, so one join finds the later row and the change. A row that is neither
    later nor of a lesser id than the kept one changes nothing.
    """
    both = before.alias("o").join(fresh.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in KEY], "full")
    had, has = F.col(f"o.{KEY[0]}").isNotNull(), F.col(f"n.{KEY[0]}").isNotNull()
    old_period, period, old_id, id_ = (F.col(c) for c in ("o.reference_period", "n.reference_period", "o.id", "n.id"))
    later = F.coalesce(period > old_period, period.isNotNull() & old_period.isNull())
    lesser = F.coalesce(id_ < old_id, id_.isNull() & old_id.isNotNull())
    wins = has & (~had | later | (period.eqNullSafe(old_period) & lesser))
    moved = wins & ~_equal("o", "n", tables.values.names)
    old = F.when(moved & had, F.struct(*[F.col(f"o.{c}") for c in tables.values.names]))
    now = [F.when(wins, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in tables.latest.names]
    return both.select(*now, moved.alias("moved"), old.alias("old"))


def _equal(left: str, right: str, columns: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


@dataclass(frozen=True)
class Brackets:
    """Where the wanted ranks lie (one row per indicator, profile, percentile and end) and the slots that hold their values."""

    ranks: DataFrame
    slots: list[int]


def brackets(tables: Ranges, fractions: dict[str, float]) -> Brackets:
    """The bin each wanted rank falls into and its place inside, from the histogram alone."""
    counted = tables.bins.read()
    spans = [F.min("first_period").alias("first_period"), F.max("last_period").alias("last_period")]
    every = counted.groupBy(*PLACE).agg(F.sum("n").alias("n"), *spans).withColumn("city_profile", F.lit(benchmarks.OVERALL))
    merged = materialise(counted.filter("city_profile IS NOT NULL").unionByName(every), "histogram")
    sizes = merged.groupBy(*GROUP).agg(F.sum("n").alias("sample_size"), *spans)
    summed = prefix_sums(merged.select(*GROUP, "bin", "n"), GROUP, F.col("bin").asc(), "n", "before").join(sizes, GROUP)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(share)).alias("share")) for name, share in fractions.items()])
    position = (F.col("sample_size") - 1) * F.col("want.share")
    asked = summed.withColumn("want", F.explode(wanted)).withColumns({"at": position, "low": F.floor(position), "high": F.ceil(position)})

    def end(rank: str) -> Column:
        inside = (F.col("before") <= F.col(rank)) & (F.col(rank) < F.col("before") + F.col("n"))
        return F.when(inside, F.struct(F.lit(rank).alias("end"), (F.col(rank) - F.col("before")).alias("place")))

    found = asked.withColumn("e", F.explode(F.array_compact(F.array(end("low"), end("high")))))
    facts = ["sample_size", "first_period", "last_period"]
    part = (F.col("at") - F.col("low")).alias("part")
    ranks = materialise(found.select(*GROUP, *facts, F.col("want.name").alias("name"), part, "bin", "e.end", "e.place"), "brackets")
    return Brackets(ranks, tables.values.slots_of(ranks))


def percentiles(tables: Ranges, fractions: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated percentiles per indicator and city profile, and over all municipalities (``geral``).

    With ``sample_size`` and the first and last period of the values.
    """
    found = brackets(tables, fractions)
    near = tables.values.read(found.slots).join(lookup(found.ranks.select(*PLACE).distinct()), PLACE, "left_semi")
    profiles = F.array_compact(F.array("city_profile", F.lit(benchmarks.OVERALL)))
    rows = near.select(*PLACE, F.explode(profiles).alias("city_profile"), "value")
    counts = rows.groupBy(*GROUP, "bin", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = prefix_sums(counts, [*GROUP, "bin"], F.col("value").asc(), "n", "before")
    hit = found.ranks.join(placed, [*GROUP, "bin"]).filter((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("n")))
    ends = [F.max(F.when(F.col("end") == end, F.col("value"))).alias(end) for end in ("low", "high")]
    both = hit.groupBy(*GROUP, "sample_size", "first_period", "last_period", "name", "part").agg(*ends)
    value = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    facts = [F.max(fact).alias(fact) for fact in ("sample_size", "first_period", "last_period")]
    return both.groupBy(*GROUP).agg(*facts, *[F.max(F.when(F.col("name") == name, value)).alias(name) for name in fractions])


def _ends(tables: Ranges) -> DataFrame:
    return percentiles(tables, {"_low": benchmarks.LOW_PERCENTILE, "_high": benchmarks.HIGH_PERCENTILE, "_least": 0.0, "_greatest": 1.0})


def suggest_benchmarks(tables: Ranges) -> DataFrame:
    """``benchmarks.suggest_benchmarks`` from the kept tables."""
    found = materialise(_ends(tables).filter(F.col("city_profile") == benchmarks.OVERALL), "ends")
    ranges = benchmarks.as_ranges(found, ["indicator_code"]).filter(F.col("sample_size") >= benchmarks.OVERALL_SAMPLE).drop("reliability")
    seen = [F.col("_least").alias("observed_minimum"), F.col("_greatest").alias("observed_maximum"), "first_period", "last_period"]
    return ranges.join(found.select("indicator_code", *seen), "indicator_code")


def profile_benchmarks(tables: Ranges) -> DataFrame:
    """``benchmarks.profile_benchmarks`` from the kept tables."""
    found = percentiles(tables, {"_low": benchmarks.LOW_PERCENTILE, "_high": benchmarks.HIGH_PERCENTILE})
    return benchmarks.sufficient(benchmarks.as_ranges(found, GROUP))


def automatic_benchmarks(tables: Ranges, indicators: DataFrame, profiles: list[str] | None = None) -> DataFrame:
    """``benchmarks.automatic_benchmarks`` from the kept tables, for every catalog indicator that has a value."""
    with_values = indicators.select("indicator_code").join(tables.bins.read().select("indicator_code").distinct(), "indicator_code", "left_semi")
    return benchmarks.offered(with_values, profile_benchmarks(tables), profiles)
