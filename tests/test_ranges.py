"""Benchmark ranges kept up to date, against numpy's percentiles of the latest values."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from civigrade.operators import benchmarks, ranges
from civigrade.session import scratch_folder

ROWS = "id long, indicator_code string, municipality_ibge_code string, reference_period string, value double"
PEOPLE = [(f"{m:07d}", [10_000, 100_000, 500_000, 2_000_000][m % 4]) for m in range(400) if m % 9]


@pytest.fixture(scope="module")
def population(spark):
    return spark.createDataFrame(PEOPLE, "ibge_code string, inhabitants long")


def published(spark, rows):
    return spark.createDataFrame(rows, ROWS).withColumn("reference_period", F.col("reference_period").cast("date"))


def batch(seed, first, n, codes=("wide", "narrow", "mixed")):
    chance = random.Random(seed)
    value = {"wide": lambda: 10 ** chance.uniform(-8, 12), "narrow": lambda: 100 + chance.random() / 1000, "mixed": lambda: chance.choice([-1, 0, 1, 1]) * 10 ** chance.uniform(-2, 4)}
    return [(first + i, code, f"{chance.randrange(400):07d}", f"20{chance.randrange(10, 24)}-01-01", value[code]()) for i in range(n) for code in [chance.choice(codes)]]


def expected(rows, shares=(0.1, 0.9)):
    newest = {}
    for row in rows:
        if row[4] is None or not np.isfinite(row[4]) or not row[2] or row[1] is None:
            continue
        key, order = row[1:3], (row[3], -row[0])
        if key not in newest or order > newest[key][0]:
            newest[key] = order, row[4]
    groups, people = {}, dict(PEOPLE)
    for (code, place), (_, value) in newest.items():
        groups.setdefault((code, "geral"), []).append(value)
        if place in people:
            profile = benchmarks.PROFILES[[10_000, 100_000, 500_000, 2_000_000].index(people[place])]
            groups.setdefault((code, profile), []).append(value)
    return {key: (len(v), *np.percentile(v, [100 * s for s in shares])) for key, v in groups.items()}


def found(tables):
    rows = ranges.percentiles(tables, {"low": 0.1, "high": 0.9}).collect()
    assert len({(r.indicator_code, r.city_profile) for r in rows}) == len(rows)
    return {(r.indicator_code, r.city_profile): (r.sample_size, r.low, r.high) for r in rows}


def files(rows):
    """The files that rows come from."""
    return {r[0] for r in rows.select(F.input_file_name()).distinct().collect()}


def same(got, wanted):
    assert got.keys() == wanted.keys()
    for key in wanted:
        assert got[key] == pytest.approx(wanted[key], rel=1e-12), key


def test_ranges_follow_imports_in_any_order(spark, population):
    tables = ranges.ranges_at(spark, scratch_folder(spark, "ranges"), 4)
    assert found(tables) == {}
    odd = [(90_001, None, "0000001", "2023-01-01", 1.0), (90_002, "wide", None, "2023-01-01", 1.0), (90_003, "wide", "", "2023-01-01", 1.0),
           (90_004, "wide", "0000001", "2023-01-01", None), (90_005, "wide", "0000001", "2024-01-01", float("nan")), (90_006, "wide", "0000001", "2024-01-01", float("inf"))]
    held = []
    for rows in (batch(1, 1000, 900) + odd, batch(2, 0, 500), batch(3, 5000, 40, ("narrow",))):
        held += rows
        ranges.put(tables, published(spark, rows), population)
    same(found(tables), expected(held))
    head = [book.head() for book in (tables.latest, tables.values, tables.bins)]
    assert not ranges.put(tables, published(spark, batch(2, 0, 500)), population)
    assert not ranges.put(tables, published(spark, []), population)
    assert [book.head() for book in (tables.latest, tables.values, tables.bins)] == head


def test_a_broken_run_is_completed_by_the_next(spark, population, monkeypatch):
    tables = ranges.ranges_at(spark, scratch_folder(spark, "ranges"), 4)
    first, second = batch(5, 0, 400), batch(6, 1000, 300)
    ranges.put(tables, published(spark, first), population)
    write = type(tables.bins).write
    for broken in ("bins", "latest"):

        def failing(self, *args, broken=broken):
            if self.root.endswith(broken):
                raise RuntimeError("lost")
            return write(self, *args)

        monkeypatch.setattr(type(tables.bins), "write", failing)
        with pytest.raises(RuntimeError):
            ranges.put(tables, published(spark, second), population)
        monkeypatch.undo()
    assert ranges.put(tables, published(spark, second), population)
    same(found(tables), expected(first + second))


def test_only_slots_of_brackets_are_read(spark, population):
    """One import into many slots: of the values only the bins that hold a wanted rank are opened."""
    tables = ranges.ranges_at(spark, scratch_folder(spark, "ranges"), 64)
    rows = batch(7, 0, 1500, ("wide",))
    ranges.put(tables, published(spark, rows), population)
    brackets = ranges.brackets(tables, {"low": 0.1, "high": 0.9})
    every, some = files(tables.values.read()), files(tables.values.read(brackets.slots))
    assert 0 < len(some) < len(every) / 2
    plan = tables.values.read(brackets.slots)._jdf.queryExecution().executedPlan().toString()
    assert "slot#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    ranges.put(tables, published(spark, batch(8, 9000, 1, ("wide",))), population)
    after = files(tables.values.read())
    assert len(every - after) <= 2 and len(after - every) <= 2
    same(found(tables), expected(rows + batch(8, 9000, 1, ("wide",))))


def test_bins_never_fall_as_values_grow(cells):
    chance = random.Random(9)
    sizes = [5e-324, 1.0, 1.7e308, *[10 ** chance.uniform(-300, 300) for _ in range(50)], *[float(np.nextafter(n, 0)) for n in range(1, 50)], *[float(n) for n in range(1, 50)]]
    values = sorted([0.0, *sizes, *[-size for size in sizes]])
    bins = cells(ranges.bin_of, values, "v double")
    assert bins == sorted(bins) and bins.count(0) == 1


def test_an_import_into_every_slot_reads_no_values(spark, population, monkeypatch):
    """What the latest rows tell is not read again from the values, however many there are."""
    tables = ranges.ranges_at(spark, scratch_folder(spark, "ranges"), 2)
    first, second = batch(11, 0, 300), batch(12, 1000, 300)
    ranges.put(tables, published(spark, first), population)
    read, seen = type(tables.values).read, []

    def noted(self, *args):
        seen.append(self.root.rsplit("/", 1)[1])
        return read(self, *args)

    monkeypatch.setattr(type(tables.values), "read", noted)
    assert ranges.put(tables, published(spark, second), population)
    monkeypatch.undo()
    assert seen == ["latest"]
    same(found(tables), expected(first + second))
    assert sorted(tables.values.read().collect()) == sorted(tables.latest.read().select(*tables.values.names).collect())


def test_candidates_are_one_row_per_key_and_force_no_broadcast(spark, population):
    rows = batch(13, 0, 600) + [(7, "wide", "0000001", None, 1.0), (8, "only", "0000001", None, 2.0), (6, "only", "0000001", None, 3.0)]
    twice = population.unionByName(population)
    found_rows = ranges.candidates(published(spark, rows), twice)
    assert "strategy=broadcast" not in found_rows._jdf.queryExecution().optimizedPlan().toString()
    kept = {(r.indicator_code, r.municipality_ibge_code): r for r in found_rows.collect()}
    assert len(kept) == found_rows.count() and kept["only", "0000001"].value == 3.0


def test_a_kept_row_stays_unless_later_or_of_a_lesser_id(spark, population):
    """Per municipality a row, the row that comes after it (id, period, value) and the value that counts then."""
    cases = [
        ((5, None, 1.0), (6, None, 2.0), 1.0),
        ((5, None, 1.0), (4, None, 3.0), 3.0),
        ((5, None, 1.0), (9, "2020-01-01", 4.0), 4.0),
        ((9, "2020-01-01", 4.0), (1, None, 5.0), 4.0),
        ((9, "2020-01-01", 4.0), (9, "2020-01-01", 6.0), 4.0),
        ((9, "2020-01-01", 4.0), (8, "2020-01-01", 900.0), 900.0),
        ((9, "2020-01-01", 4.0), (10, "2021-01-01", 900.0), 900.0),
        ((9, "2020-01-01", 4.0), (1, "2019-01-01", 900.0), 4.0),
        ((9, "2020-01-01", 4.0), (None, "2020-01-01", 5.0), 5.0),
    ]
    tables = ranges.ranges_at(spark, scratch_folder(spark, "ranges"), 1)
    for side in (0, 1):
        rows = [(case[side][0], "wide", f"{place:07d}", *case[side][1:]) for place, case in enumerate(cases)]
        ranges.put(tables, published(spark, rows), population)
    expected_values = {f"{place:07d}": case[2] for place, case in enumerate(cases)}
    for book in (tables.latest, tables.values):
        rows = book.read().collect()
        assert len(rows) == len(cases) and {r.municipality_ibge_code: r.value for r in rows} == expected_values
    assert sum(r.n for r in tables.bins.read().collect()) == len(cases)
