import pytest
from pyspark.sql import functions as F

from civigrade.operators import benchmarks, index, joins, series
from civigrade.plans import catalog

DIMENSIONS = [("eco", 60.0), ("pes", 40.0)]
INDICATORS = [("eco01_a", "A", "eco", "direct", None), ("eco02_b", "B", "eco", "inverse", None), ("pes01_c", "C", "pes", "checklist", 5.0), ("pes02_x", "X", "pes", "direct", None)]
RANGES = [("eco01_a", 0.0, 100.0), ("eco02_b", 0.0, 100.0)]
PLACES = [("1111111", "São Paulo", "SP"), ("2222222", "Belo Horizonte", "MG"), ("3333333", "Campinas", "SP"), ("4444444", "Santos", "SP")]
VALUES = [
    ("1111111", "eco01_a", 50.0, "2024-01-01"), ("1111111", "eco02_b", 20.0, "2024-01-01"), ("1111111", "pes01_c", 4.0, "2024-01-01"),
    ("2222222", "eco01_a", 90.0, "2024-01-01"), ("3333333", "pes02_x", 10.0, "2024-01-01"),
    ("4444444", "eco01_a", 10.0, "2020-01-01"), ("4444444", "eco01_a", 30.0, "2024-01-01"),
]


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "published": published(spark, VALUES),
        "indicators": spark.createDataFrame(INDICATORS, "indicator_code string, indicator_name string, dimension_code string, score_direction string, checklist_max double"),
        "dimensions": spark.createDataFrame(DIMENSIONS, "dimension_code string, weight double"),
        "benchmarks": spark.createDataFrame(RANGES, "indicator_code string, minimum_value double, maximum_value double"),
        "municipalities": spark.createDataFrame(PLACES, "ibge_code string, name string, state string"),
    }


def published(spark, values):
    rows = [(f"{m}-{i}-{p}", m, i, v, p) for m, i, v, p in values]
    df = spark.createDataFrame(rows, "id string, municipality_ibge_code string, indicator_code string, value double, p string")
    return df.withColumn("reference_period", F.to_date("p")).withColumn("unit", F.lit("%")).withColumn("source_name", F.lit("s"))


def ranked(tables):
    return index.rank_municipalities(**tables)


def test_ranking(tables):
    rows = index.competition_rank(ranked(tables), F.col("overall_score")).orderBy("rank").collect()
    assert [(r["rank"], r["municipality_ibge_code"], r["overall_score"]) for r in rows] == [(1, "2222222", 90.0), (2, "1111111", 71.0), (3, "4444444", 30.0)]
    second = rows[1]
    assert (second["name"], second["maturity"], second["scored_indicators"]) == ("São Paulo", "Nível 4 - Gerenciado", 3)
    assert {k: round(v, 6) for k, v in second["dimension_scores"].items()} == {"eco": 65.0, "pes": 80.0}


def test_ranking_equals_the_diagnosis_of_each_municipality(tables):
    overall = {r["municipality_ibge_code"]: r["overall_score"] for r in ranked(tables).collect()}
    others = {k: v for k, v in tables.items() if k != "municipalities"}
    for code in overall:
        detail = index.diagnosis(*others.values(), codes=[code])
        summary = index.diagnosis_summary(detail, tables["dimensions"])
        assert index.overall_scores(summary, tables["dimensions"]).first()["overall_score"] == overall[code]


def test_a_missing_latest_value_is_not_replaced_by_an_older_one(spark, tables):
    extra = tables["published"].unionByName(published(spark, [("2222222", "eco01_a", None, "2025-01-01")]))
    codes = {r["municipality_ibge_code"] for r in ranked({**tables, "published": extra}).collect()}
    assert "2222222" not in codes


def test_rows_that_tie_do_not_depend_on_the_join_with_the_catalog(spark, tables, monkeypatch):
    """Repeated ids of one period: the same row is the latest, in whatever order they come, with the catalog broadcast or not."""
    tied = [("1111111", "eco01_a", v, "2024-01-01") for v in (90.0, 10.0, 70.0)]
    others = [v for k, v in tables.items() if k not in ("published", "municipalities")]
    for size in (0, 1 << 62):
        monkeypatch.setattr(joins, "planned_bytes", lambda df: size)
        for values in (tied, tied[::-1]):
            assert [r["value"] for r in index.score_latest(published(spark, values).coalesce(1), *others).collect()] == [10.0]


def test_the_ranking_holds_keys_of_a_million_and_more(spark, tmp_path):
    """The query ranks every municipality of the model, as its SQL does; the codes of large keys have eight digits."""
    keys = range(999_950, 1_000_070)
    orders = [(i, key, "O", 400_000.0 - 1000 * i, "1-URGENT") for i, key in enumerate(keys)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").withColumn(
        "o_orderdate", F.to_timestamp(F.lit("1997-05-03"))
    ).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(key, f"Customer#{key}", 0) for key in keys], "c_custkey long, c_name string, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(0, "NATION_0")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    page = catalog.QUERIES["a3_seek_page"](spark, str(tmp_path)).collect()
    assert [(r["rank"], r["municipality_ibge_code"]) for r in page] == [(i + 1, f"{keys[i]}{keys[i] % 10}") for i in range(60, 100)]


def test_pages_search_and_ties(spark, tables):
    scores = spark.createDataFrame(
        [("1", "Ávila", "SP", 90.0), ("2", "b", "SP", 80.0), ("3", "a", None, 80.0), ("4", "d", "MG", 70.0), ("5", "e", "MG", None)],
        "municipality_ibge_code string, name string, state string, overall_score double",
    ).withColumn("dimension_scores", F.expr("map('eco', overall_score / 2)")).withColumn("scored_indicators", F.lit(1))
    page = index.ranking_page(scores).collect()
    assert [(r["rank"], r["name"]) for r in page] == [(1, "Ávila"), (2, "a"), (2, "b"), (4, "d")]
    assert [r["rank"] for r in index.ranking_page(scores, search="D").collect()] == [4]
    assert [r["name"] for r in index.ranking_page(scores, search="avila").collect()] == ["Ávila"]
    assert [r["name"] for r in index.ranking_page(scores, sort="name", limit=2, offset=1).collect()] == ["Ávila", "b"]
    assert index.ranking_page(scores, "eco").first()["score"] == 45.0


def test_compare(spark, tables):
    others = [v for k, v in tables.items() if k != "municipalities"]
    detail = index.diagnosis(*others)
    with pytest.raises(ValueError):
        index.compare(detail, ["1111111", "1111111"])
    rows = index.compare(detail, ["2222222", "1111111"]).filter(F.col("indicator_code") == "eco01_a").orderBy("place").collect()
    assert [(r["municipality_ibge_code"], r["score"]) for r in rows] == [("2222222", 90.0), ("1111111", 50.0)]


@pytest.mark.parametrize("scores, best", [([50.0, 80.0, None], [1]), ([80.0, 80.0], []), ([90.0, 90.0, 10.0], [0, 1]), ([None, 5.0], [])])
def test_best_in_row(spark, scores, best):
    rows = spark.createDataFrame([("r", i, s) for i, s in enumerate(scores)], "row string, i int, score double")
    assert sorted(r["i"] for r in index.best_in_row(rows, ["row"]).filter("is_best").collect()) == best


def test_strongest_and_weakest(spark):
    rows = spark.createDataFrame(
        [("m", "eco", 50.0, 3, 5), ("m", "pes", 70.0, 2, 2), ("m", "gov", None, 0, 4), ("n", "eco", 1.0, 1, 1)],
        "municipality_ibge_code string, dimension_code string, dimension_score double, observed_indicators long, total_indicators long",
    )
    got = {r["municipality_ibge_code"]: (r["strongest_dimension"], r["weakest_dimension"], r["missing_indicators"]) for r in index.strongest_and_weakest(rows).collect()}
    assert got == {"m": ("pes", "eco", 6), "n": ("eco", None, 0)}


def test_series_summary(spark):
    rows = published(spark, [("m", "i", 10.0, "2020-01-01"), ("m", "i", 30.0, "2021-01-01"), ("m", "i", 15.0, "2022-01-01"), ("z", "i", 0.0, "2020-01-01"), ("z", "i", 5.0, "2021-01-01"), ("z", "i", None, "2022-01-01")])
    got = {r["municipality_ibge_code"]: r for r in series.series_summary(rows, ["municipality_ibge_code"]).collect()}
    assert (got["m"]["change"], got["m"]["change_percent"], got["m"]["max_value"], str(got["m"]["min_period"])) == (5.0, 50.0, 30.0, "2020-01-01")
    assert got["z"]["change_percent"] is None and got["z"]["last_value"] == 5.0


@pytest.mark.parametrize("small_group", [10_000, 0])
def test_exact_percentiles(spark, small_group):
    rows = spark.range(1, 101).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("value"))
    rows = rows.unionByName(spark.createDataFrame([("b", v) for v in (0.0, 10.0, 20.0, 30.0, 40.0)], "g string, value double"))
    if small_group == 0:
        rows = rows.filter("g = 'a'")
    got = {r["g"]: (round(r["lo"], 9), round(r["hi"], 9), r["sample_size"]) for r in benchmarks.exact_percentiles(rows, ["g"], {"lo": 0.1, "hi": 0.9}, 10_000).collect()}
    assert got["a"] == (10.9, 90.1, 100)
    if "b" in got:
        assert got["b"] == (4.0, 36.0, 5)


def test_bracketed_percentiles_equal_the_built_in_ones(spark):
    """Groups far above the small-group limit: skewed, uniform and mostly one value."""
    rows = spark.range(0, 200_000).select(
        F.explode(F.array(F.lit("skewed"), F.lit("uniform"), F.lit("spike"))).alias("g"), "id"
    ).withColumn(
        "value",
        F.when(F.col("g") == "skewed", F.exp(F.pmod(F.xxhash64("id"), F.lit(1000003)) / 100000.0))
        .when(F.col("g") == "uniform", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(999983)).cast("double"))
        .otherwise(F.when(F.pmod(F.xxhash64("id"), F.lit(10)) < 8, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(101)).cast("double"))),
    )
    got = {r["g"]: (r["lo"], r["hi"]) for r in benchmarks.exact_percentiles(rows, ["g"], {"lo": 0.1, "hi": 0.9}, 1000).collect()}
    want = {r["g"]: (r["p"][0], r["p"][1]) for r in rows.groupBy("g").agg(F.expr("percentile(value, array(0.1, 0.9))").alias("p")).collect()}
    for group, pair in want.items():
        assert got[group] == pytest.approx(pair, rel=1e-12), group


def test_profile_benchmarks(spark):
    values = [(f"{c:07d}", "i", float(c), "2024-01-01") for c in range(1, 41)] + [(f"{1000 + c:07d}", "i", 100.0 + c, "2024-01-01") for c in range(1, 36)]
    values += [(f"{5000 + c:07d}", "i", 500.0 + c, "2024-01-01") for c in range(1, 4)] + [(f"{9000 + c:07d}", "j", c * 3.0, "2024-01-01") for c in range(1, 13)]
    people = [(m, 10_000 if int(m) < 1000 else 100_000 if int(m) < 5000 else 5_000_000) for m, *_ in values]
    population = spark.createDataFrame(people, "ibge_code string, inhabitants long")
    rows = benchmarks.profile_benchmarks(published(spark, values), population).collect()
    got = {(r["indicator_code"], r["city_profile"]): r for r in rows}
    assert set(got) == {("i", "pequeno"), ("i", "medio"), ("i", "geral"), ("j", "metropole")}
    assert got["i", "pequeno"]["sample_size"] == 40 and got["i", "medio"]["minimum_value"] > 100
    assert (got["j", "metropole"]["sample_size"], got["j", "metropole"]["reliability"]) == (12, "baixa")
    indicators = spark.createDataFrame([("i",), ("j",), ("empty",)], "indicator_code string")
    automatic = {(r["indicator_code"], r["city_profile"]): (r["origin"], r["reason"]) for r in benchmarks.automatic_benchmarks(published(spark, values), population, indicators).collect()}
    assert automatic["i", "grande"] == ("geral", None) and automatic["i", "medio"] == ("porte", None)
    assert automatic["j", "medio"] == (None, "amostra insuficiente") and ("empty", "medio") not in automatic


def test_population_year_falls_back(spark):
    rows = spark.range(1000).select(F.explode(F.array(F.lit(2022), F.lit(2024))).alias("year"), F.format_string("%07d", "id").alias("ibge_code"), (F.col("id") + 1).alias("inhabitants"))
    lone = spark.createDataFrame([(2025, "0000001", 5)], "year int, ibge_code string, inhabitants long")
    profiles = benchmarks.municipality_profiles(rows.unionByName(lone), 2026)
    assert profiles.select("population_year").distinct().collect()[0][0] == 2024 and profiles.count() == 1000
    assert benchmarks.latest_population(rows, 2030).select("year").distinct().collect()[0][0] == 2022
