from pathlib import Path

import pytest
from pyspark.sql import functions as F

from civigrade.operators import delta, ledger, publication
from civigrade.session import scratch_folder

SLOTS = 16


def files(book):
    """Data files with the times they were written."""
    root = Path(book.root.removeprefix("file:"))
    return {str(f.relative_to(root)): f.stat().st_mtime_ns for f in root.glob("data/**/part-*")}


@pytest.fixture()
def book(spark):
    rows = spark.range(2000).select((F.col("id") % 40).cast("string").alias("import_id"), F.lit("x").alias("indicator_code"), F.col("id").alias("k"), F.col("id").cast("double").alias("v"))
    return ledger.create(rows, scratch_folder(spark, "ledger"), ("import_id", "indicator_code"), ("k",), SLOTS)


def state(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_only_touched_slots_are_read_and_written(spark, book):
    before, rows = files(book), state(book.read())
    incoming = spark.createDataFrame([("7", "x", 7, -1.0), ("7", "x", 99_999, 5.0)], "import_id string, indicator_code string, k long, v double")
    slot = book.slots_of(incoming)
    assert len(slot) == 1
    commit = ledger.upsert_slots(book, incoming, ["import_id", "indicator_code", "k"])
    assert commit == 1 and book.head() == 1 and book.changed_since(0) == slot
    after = files(book)
    assert {f: t for f, t in after.items() if f in before} == before
    assert {f.split("/")[2] for f in set(after) - set(before)} == {f"slot={slot[0]}"}
    expected = [r for r in rows if r[2] != 7] + [("7", "x", 7, -1.0), ("7", "x", 99_999, 5.0)]
    assert state(book.read()) == sorted(expected, key=str)
    assert state(book.read(upto=0)) == rows
    some = book.read(slot)
    assert {f.split("commit=")[1].split("/")[0] for f in some.inputFiles()} == {"1"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and f"slot#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert len([r for r in rows if r in state(some)]) < 2000 / 4


def test_repeating_a_change_commits_nothing(spark, book):
    incoming = book.read().filter("k < 10").withColumn("v", F.col("v") + 1)
    keys = ["import_id", "indicator_code", "k"]
    assert ledger.upsert_slots(book, incoming, keys) is not None
    rows = state(book.read())
    again = spark.createDataFrame([r for r in rows if r[2] < 10], book.columns)
    before = files(book)
    assert ledger.upsert_slots(book, again.repartition(5), keys) is None
    assert files(book) == before and state(book.read()) == rows
    assert ledger.upsert_slots(book, again.filter("k < 0"), keys) is None


def test_second_of_two_writers_is_refused(book):
    base, slots = book.head(), [3]
    rows = book.read(slots)
    assert book.write(rows.withColumn("v", F.lit(0.0)), slots, base) is not None
    with pytest.raises(ledger.Conflict):
        book.write(rows.withColumn("v", F.lit(1.0)), slots, base)
    assert {r[3] for r in state(book.read(slots))} <= {0.0}


def test_rows_of_other_slots_are_refused(book):
    slots = [int(r[0]) for r in book.live().select("slot").limit(1).collect()]
    with pytest.raises(ValueError):
        book.write(book.read(), slots, book.head())


def test_emptied_slots_null_keys_and_old_versions(spark, book):
    slot = book.slots_of(book.read().filter("import_id = '7'"))
    assert book.write(book.read(slot).filter("false"), slot, book.head()) is not None
    assert book.read(slot).collect() == [] and book.slots_of(book.read()) == sorted(set(r[0] for r in book.live().filter("n > 0").select("slot").collect()))
    odd = spark.createDataFrame([(None, None, 1, None), ("", "x", 2, 1.0)], book.columns)
    for _ in range(2):
        ledger.upsert_slots(book, odd, ["import_id", "indicator_code", "k"])
    assert [r for r in state(book.read()) if not r[0]] == sorted([(None, None, 1, None), ("", "x", 2, 1.0)], key=str)
    every = list(range(SLOTS))
    book.write(book.read(), every, book.head())
    rows = state(book.read())
    book.write(book.read().withColumn("v", F.lit(2.0)), every, book.head())
    assert book.drop_versions(book.head()) > 0
    assert [r[:3] for r in state(book.read())] == [r[:3] for r in rows]


def test_empty_ledger(spark):
    empty = delta.observation_ledger(publication.empty(spark, publication.OBSERVATION), scratch_folder(spark, "none"), SLOTS)
    assert empty.read().collect() == [] and empty.head() == -1


CATALOG = [("3509502",), ("3550308",), ("1100015",)]
SCOPE = [("imp", "ind", "A"), ("imp", "ind", "B")]


def candidates(spark, rows, import_id="imp"):
    df = spark.createDataFrame(rows, "sheet_name string, row_number long, municipality_code string, year int, value double")
    prepared = df.select(
        F.lit(import_id).alias("import_id"), F.lit("ind").alias("indicator_code"), "sheet_name", "row_number", "municipality_code",
        F.struct("year", F.lit(None).cast("int").alias("month")).alias("period"), F.col("value").cast("decimal(38,10)").alias("value"), F.lit("u").alias("unit"),
    )
    return publication.prepared_candidates(prepared)


@pytest.fixture()
def books(spark):
    none = [publication.empty(spark, schema) for schema in (publication.OBSERVATION, publication.ISSUE, publication.PUBLISHED)]
    makers = (delta.observation_ledger, delta.issue_ledger, delta.published_ledger)
    return [make(rows, scratch_folder(spark, "book"), SLOTS) for make, rows in zip(makers, none)]


def approve(spark, books, rows, day, sheets=("A", "B"), import_id="imp"):
    scope = spark.createDataFrame([(import_id, "ind", sheet) for sheet in sheets], "import_id string, indicator_code string, sheet_name string")
    return delta.approve(candidates(spark, rows, import_id), books[0], books[1], F.lit(day).cast("timestamp"), scope)


def test_approvals_supersede_only_what_changed(spark, books):
    first = [("A", 1, "3509502", 2020, 1.0), ("A", 2, "3550308", 2020, 2.0), ("B", 3, "1100015", 2020, 3.0), ("B", 4, "3550308", None, 3.0)]
    done = approve(spark, books, first, "2024-01-01")
    assert done.observations is not None and done.issues is not None and len(done.slots) == 1
    rows = state(books[0].read())
    assert len(rows) == 3 and {r.field for r in books[1].read().collect()} == {"reference_year"}
    again = approve(spark, books, first, "2024-02-01")
    assert (again.observations, again.issues) == (None, None) and state(books[0].read()) == rows
    changed = [("A", 1, "3509502", 2020, 1.5), ("A", 2, "3550308", 2020, 2.0), ("B", 3, "1100015", 2020, 3.0)]
    third = approve(spark, books, changed, "2024-03-01")
    assert third.observations is not None and third.issues is not None and books[1].read().collect() == []
    after = books[0].read().collect()
    assert len(after) == 4
    assert {(r.source_row_number, float(r.value)): str(r.superseded_at)[:10] for r in after if r.superseded_at} == {(1, 1.0): "2024-03-01"}
    gone = approve(spark, books, changed[:2], "2024-04-01", sheets=("A", "B"))
    assert gone.observations is not None
    assert {r.source_row_number for r in books[0].read().filter("superseded_at IS NULL").collect()} == {1, 2}


def test_delta_gives_the_rows_of_the_whole_approval(spark, books):
    """Sheets approved one after another, conflicts and duplicates included, against the function over whole tables."""
    runs = [
        (("A",), [("A", 1, "3509502", 2020, 1.0), ("A", 2, "3509502", 2021, 1.0), ("A", 3, "bad", 2021, 1.0)]),
        (("B",), [("B", 1, "3509502", 2020, 2.0), ("B", 2, "1100015", 2020, 2.0), ("B", 3, "1100015", 2020, 4.0), ("B", 4, "3550308", 2020, None)]),
        (("A",), [("A", 1, "3509502", 2020, 1.25)]),
    ]
    observations, issues = publication.empty(spark, publication.OBSERVATION), publication.empty(spark, publication.ISSUE)
    for day, (sheets, rows) in enumerate(runs, 1):
        approve(spark, books, rows, f"2024-01-0{day}", sheets)
        now = F.lit(f"2024-01-0{day}").cast("timestamp")
        scope = spark.createDataFrame([("imp", "ind", s) for s in sheets], "import_id string, indicator_code string, sheet_name string")
        whole = publication.approve(candidates(spark, rows), observations, issues, now, scope=scope)
        observations, issues = spark.createDataFrame(whole.observations.collect(), publication.OBSERVATION), spark.createDataFrame(whole.issues.collect(), publication.ISSUE)
        active = lambda df: state(df.filter("superseded_at IS NULL"))
        assert active(books[0].read()) == active(observations)
        assert state(books[1].read()) == state(issues)


def test_sync_reads_only_changed_slots(spark, books):
    imports = spark.createDataFrame([("imp", "d"), ("other", "d")], "import_id string, dataset_id string")
    indicators = spark.createDataFrame([("ind", "Name")], "indicator_code string, indicator_name string")
    approve(spark, books, [("A", 1, "3509502", 2020, 1.0)], "2024-01-01")
    approve(spark, books, [("A", 1, "3550308", 2020, 7.0)], "2024-01-01", import_id="other")
    now = F.lit("2024-02-01").cast("timestamp")
    assert delta.sync(books[2], books[0], imports, indicators, now, since=-1) is not None
    ids = {r.import_id: r.id for r in books[2].read().collect()}
    since, before = books[0].head(), files(books[2])
    assert delta.sync(books[2], books[0], imports, indicators, now, since) is None
    approve(spark, books, [("A", 1, "3509502", 2020, 2.0), ("A", 2, "1100015", 2020, 2.0)], "2024-03-01")
    commit = delta.sync(books[2], books[0], imports, indicators, F.lit("2024-04-01").cast("timestamp"), since)
    assert commit is not None and {f: t for f, t in files(books[2]).items() if f in before} == before
    rows = books[2].read().filter("superseded_at IS NULL").collect()
    assert {(r.import_id, float(r.value)) for r in rows} == {("imp", 2.0), ("other", 7.0)} and len(rows) == 3
    assert {r.import_id: r.id for r in rows if r.municipality_ibge_code != "1100015"} == ids


def test_null_imports_are_published_or_told(spark):
    """A valid candidate without an import is judged like any other."""
    rows = candidates(spark, [("A", 1, "3509502", 2020, 1.0), ("A", 2, "3550308", 2020, 1.0), ("A", 3, "3550308", 2020, 2.0)]).withColumn("import_id", F.lit(None).cast("string"))
    none = publication.empty(spark, publication.OBSERVATION)
    marked = publication.mark(rows, none)
    assert sorted((r.row_number, r.duplicate_count) for r in marked.collect()) == [(1, 1), (2, 2), (3, 2)]
    assert {r.source_row_number for r in publication.accepted(marked).collect()} == {1}
    assert {r.row_number for r in publication.issues_of(marked, publication.FieldNames()).collect()} == {2, 3}
