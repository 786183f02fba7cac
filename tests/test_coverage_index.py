"""Coverage from bitmaps, against counts of distinct municipalities."""

import random

from pyspark.sql import functions as F

from civigrade.operators import coverage, coverage_index
from civigrade.session import scratch_folder

ROWS = "import_id string, indicator_code string, municipality_ibge_code string, reference_period string"


def serving(spark, rows):
    return spark.createDataFrame(rows, ROWS).withColumn("reference_period", F.col("reference_period").cast("date"))


def imported(seed, import_id, n, places):
    chance = random.Random(seed)
    return [(import_id, chance.choice(["a", "b", None]), chance.choice([*places, None]), f"20{chance.randrange(10, 24)}-0{chance.randrange(1, 10)}-01") for _ in range(n)]


def state(df):
    return sorted((tuple(r) for r in df.select("indicator_code", "municipalities", "value_count", "first_period", "last_period").collect()), key=str)


def test_coverage_of_any_choice_of_imports(spark):
    index = coverage_index.coverage_at(spark, scratch_folder(spark, "coverage"), 4)
    assert state(coverage_index.indicator_coverage(index)) == []
    odd = [("x", "a", "", "2020-01-01"), ("x", "a", "not a code", None), (None, "a", "0000001", "2019-01-01")]
    parts = [imported(1, "i", 200, [f"{n:07d}" for n in range(90)]), imported(2, "j", 200, [f"{n:07d}" for n in range(50, 140)]) + odd]
    for rows in parts:
        assert coverage_index.put(index, serving(spark, rows)) is not None
    every = serving(spark, [row for rows in parts for row in rows])
    assert state(coverage_index.indicator_coverage(index)) == state(coverage.indicator_coverage(every))
    for chosen in (["i"], ["j", None], ["none"]):
        choice = spark.createDataFrame([(c,) for c in chosen], "import_id string")
        wanted = every.join(choice, every["import_id"].eqNullSafe(choice["import_id"]), "left_semi")
        assert state(coverage_index.indicator_coverage(index, choice)) == state(coverage.indicator_coverage(wanted)), chosen

    head = index.summaries.head(), index.numbers.head()
    assert coverage_index.put(index, serving(spark, parts[0])) is None
    assert coverage_index.withdraw(index, spark.createDataFrame([("none",)], "import_id string")) is None
    assert (index.summaries.head(), index.numbers.head()) == head
    assert coverage_index.withdraw(index, spark.createDataFrame([("i",), (None,)], "import_id string")) is not None
    left = every.filter("import_id IN ('j', 'x')")
    assert state(coverage_index.indicator_coverage(index)) == state(coverage.indicator_coverage(left))
    asked = spark.createDataFrame([("i",), ("x",)], "import_id string")
    assert {tuple(r) for r in coverage_index.impact(index, asked).collect()} == {("i", 0, 0), ("x", 2, 1)}


def test_numbers_stay_and_are_unique(spark):
    index = coverage_index.coverage_at(spark, scratch_folder(spark, "coverage"), 4)
    codes = lambda *ns: spark.createDataFrame([(f"{n:07d}",) for n in ns], "municipality_ibge_code string").repartition(3)
    coverage_index.number_codes(index, codes(*range(40)))
    before = {r[0]: r[1] for r in index.numbers.read().collect()}
    assert coverage_index.number_codes(index, codes(3, 4, 3)) is None
    coverage_index.number_codes(index, codes(*range(30, 60)))
    after = {r[0]: r[1] for r in index.numbers.read().collect()}
    assert len(after) == len(set(after.values())) == 60 and before.items() <= after.items()
