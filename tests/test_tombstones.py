"""Marks of imports, against the functions over whole tables."""

import pytest
from pyspark.sql import functions as F

from civigrade.operators import tombstones
from civigrade.session import scratch_folder

SCHEMAS = {"published": "import_id string, k long, superseded_at timestamp", "rows": "import_id string, k long"}


def now():
    return F.lit("2024-05-01").cast("timestamp")


@pytest.fixture()
def facts(spark):
    published = spark.range(60).select(
        F.when(F.col("id") < 58, (F.col("id") % 12).cast("string")).alias("import_id"), F.col("id").alias("k"),
        F.when(F.col("id") % 5 == 0, F.lit("2023-01-01").cast("timestamp")).alias("superseded_at"),
    )
    tables = {"published": published, "rows": published.select("import_id", "k")}
    made = tombstones.facts_at(spark, scratch_folder(spark, "facts"), {name: df.schema for name, df in tables.items()}, 8)
    for name, df in tables.items():
        tombstones.put(made, name, df)
    return made


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "import_id string")


def state(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(table):
    return {r[0] for r in table.read().select(F.input_file_name()).distinct().collect()}


def test_marks_are_read_at_once_and_compacted_in_place(spark, facts):
    before = {name: (state(table.read()), files(table)) for name, table in facts.tables.items()}
    assert {(r.table, r.import_id, r.rows, r.active) for r in tombstones.counts(facts, ids(spark, "5", "none")).collect()} == {("published", "5", 5, 4), ("rows", "5", 5, 5)}
    tombstones.withdraw(facts, ids(spark, "3", "5", "none"), now())
    tombstones.delete(facts, ids(spark, "5", None), now())
    assert {name: (state(table.read()), files(table)) for name, table in facts.tables.items()} == before

    rows = [r for r in before["published"][0] if r[0] not in ("5", None)]
    stamp = spark.sql("SELECT timestamp'2024-05-01'").first()[0]
    wanted = sorted([(i, k, at or stamp) if i == "3" else (i, k, at) for i, k, at in rows], key=str)
    assert state(tombstones.read(facts, "published")) == wanted
    left = [r for r in before["rows"][0] if r[0] not in ("5", None)]
    assert state(tombstones.read(facts, "rows")) == left

    slots = set(facts.tables["rows"].slots_of(ids(spark, "3", "5", None, "none")))
    assert set(tombstones.compact(facts)) == {"published", "rows"}
    assert state(facts.tables["published"].read()) == wanted and state(facts.tables["rows"].read()) == left
    assert facts.marks.read().isEmpty()
    for name, table in facts.tables.items():
        kept = {f for f in before[name][1] if int(f.split("slot=")[1].split("/")[0]) not in slots}
        assert kept and kept <= files(table)
    assert tombstones.compact(facts) == {}


def test_imports_that_come_again_are_not_hidden(spark, facts):
    tombstones.delete(facts, ids(spark, "7"), now())
    again = spark.createDataFrame([("7", 700, None)], SCHEMAS["published"])
    tombstones.put(facts, "published", again)
    assert [r for r in state(tombstones.read(facts, "published")) if r[0] == "7"] == [("7", 700, None)]
    assert [r for r in state(tombstones.read(facts, "rows")) if r[0] == "7"] == []
    assert tombstones.withdraw(facts, ids(spark), now()) is None
