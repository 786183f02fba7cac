import pytest
from pyspark.sql import functions as F

from civigrade.operators import filters, geography, search_index
from civigrade.session import scratch_folder

NAMES = ["São José", "São João do Sul", "Santos", "Campinas", "Xique-Xique", "A", "", None, "Bom Jesus", "Bom Jesus", "São-José dos Ausentes", "Ção", "100% Legal", "a_b", "漢字の町"]


@pytest.fixture(scope="module")
def places(spark):
    rows = [(f"{i * 7:07d}", NAMES[i % len(NAMES)] and f"{NAMES[i % len(NAMES)]}" + ("" if i < 30 else f" {i}"), ("SP", "RS", None)[i % 3], i) for i in range(400)]
    return spark.createDataFrame(rows, "ibge_code string, name string, state string, number long").repartition(5)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("range_rows", [65_536, 37])
def test_searches_equal_the_scan(spark, places, range_rows):
    root = lambda: scratch_folder(spark, "index")
    by_place = search_index.build(places, search_index.place_text(), "number", root(), range_rows)
    for text in ("são", "JOSE", "sa", "x", "Bom Jesus (RS)", "Bom Jesus", "000", "0000014", "9", "campinas 12", "not there", "漢字", "ção", " ", "São José"):
        assert rows_of(search_index.search_places(by_place, text, 1000)) == rows_of(geography.search_catalog(places, text, 1000)), text
    registered = search_index.build(places, search_index.registered_text(), "number", root(), range_rows)
    for text in ("", "são", "0_14", "0%", "%", "Jesus 2", "nowhere", "a\\_b", "legal", "JOSÉ", "漢"):
        assert rows_of(search_index.search_registered(registered, text, 1000)) == rows_of(geography.search_registered(places, text, 1000)), text
    fields = ("ibge_code", "name", "state")
    catalog = search_index.build(places, search_index.catalog_text(fields), "number", root(), range_rows)
    for text in ("", "sao sp", "bom  JESUS r", "0000014", "zzz", "s", "são 3"):
        found, scan = (sorted(rows_of(df), key=str) for df in (search_index.search_rows(catalog, text, fields), filters.search_catalog_rows(places, text, fields)))
        assert found == scan, text


def test_a_search_reads_postings_and_hits_only(spark, places):
    index = search_index.build(places, search_index.place_text(), "number", scratch_folder(spark, "index"), 10)
    found = search_index.search_places(index, "0000014", 10)
    files = found.inputFiles()
    rows = {f for f in files if "/rows/" in f}
    buckets = {f.split("bucket=")[1].split("/")[0] for f in files if "/grams/" in f}
    assert len({f.split("range=")[1].split("/")[0] for f in rows}) <= 40 and len(buckets) < search_index.BUCKETS
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "range#" in plan.split("PartitionFilters")[1]
    scanned = [line for line in plan.split("\n") if "/rows" in line]
    assert scanned and all("range" in line.split("PartitionFilters")[1].split("PushedFilters")[0] for line in scanned)


def test_empty_catalog(spark, places):
    index = search_index.build(places.filter("false"), search_index.place_text(), "number", scratch_folder(spark, "index"))
    assert rows_of(search_index.search_places(index, "santos")) == [] and rows_of(search_index.search_registered(index, "")) == []
