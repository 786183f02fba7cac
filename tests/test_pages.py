import re

import pytest
from pyspark.sql import functions as F

from civigrade.operators import pages
from civigrade.session import scratch_folder


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).select(
        F.col("id"), (F.col("id") * 37 % 101).alias("score"), F.when(F.col("id") % 50 > 0, F.concat(F.lit("n"), (F.col("id") % 7).cast("string"))).alias("name")
    ).repartition(6)


@pytest.fixture(scope="module")
def book(spark, rows):
    return pages.pages_of_ranking(rows, "score", F.col("name"), "id", scratch_folder(spark, "pages"), range_rows=64)


@pytest.fixture(scope="module")
def expected(rows):
    return [tuple(r) for r in sorted(rows.collect(), key=lambda r: (-r.score, r.name is not None, r.name or "", r.id))]


def got(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("limit,offset", [(10, 0), (1, 999), (50, 990), (64, 63), (128, 500), (5, 1000), (7, 10**9), (2000, 0)])
def test_pages_by_offset(book, expected, limit, offset):
    page = book.page(limit, offset)
    assert page.columns == ["id", "score", "name"]
    assert got(page) == expected[offset : offset + limit]


def test_deep_pages_open_two_ranges_at_most(book):
    for page in (book.page(20, 940), book.page(20, 0)):
        plan = page._jdf.queryExecution().executedPlan().toString()
        named = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
        assert 1 <= len(re.findall(r"\d+", re.search(r"range#\d+ (?:IN \(([\d,]+)\)|= (\d+))", named).group(0).split("range#")[1])) - 1 <= 2


def test_pages_by_last_row(book, expected):
    last, seen = None, []
    while True:
        page = got(book.page(90)) if last is None else got(book.after({"_k_score": -last[1], "_k_name": last[2], "_k_code": last[0]}, 90))
        seen += page
        if len(page) < 90:
            break
        last = page[-1]
    assert seen == expected
    between = got(book.after({"_k_score": -50.5, "_k_name": "", "_k_code": 0}, 5))
    assert between == [r for r in expected if r[1] < 50.5][:5] or between == [r for r in expected if r[1] <= 50][:5]
    assert got(book.after({"_k_score": -10**6, "_k_name": None, "_k_code": 0}, 3)) == expected[:3]
    assert got(book.after({"_k_score": 1, "_k_name": "", "_k_code": 0}, 3)) == []


def test_totals_empty_tables_and_refusals(spark, rows, book):
    assert book.total() == 1000
    none = pages.pages_of_ranking(rows.filter("false"), "score", F.col("name"), "id", scratch_folder(spark, "pages"))
    assert none.total() == 0 and got(none.page(5)) == [] and got(none.after({"_k_score": 0, "_k_name": "", "_k_code": 0}, 5)) == []
    for limit, offset in ((0, 0), (1, -1)):
        with pytest.raises(ValueError):
            book.page(limit, offset)


def test_short_ranges_grow_with_the_table(spark, rows, expected, monkeypatch):
    """However short the ranges, their number is bounded, so the driver's sample and table do not follow the rows."""
    monkeypatch.setattr(pages, "MOST_RANGES", 10)
    few = pages.pages_of_ranking(rows, "score", F.col("name"), "id", scratch_folder(spark, "pages"), range_rows=2)
    assert few._ranges().count() <= 10
    assert got(few.page(30, 480)) == expected[480:510]
    monkeypatch.setattr(pages, "RANGE_ROWS", 50)
    assert 10 < pages.pages_of_ranking(rows, "score", F.col("name"), "id", scratch_folder(spark, "pages"), range_rows=2)._ranges().count() <= 20
