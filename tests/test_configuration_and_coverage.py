import json

from pyspark.sql import functions as F

from civigrade.operators import configuration, coverage


def weights(spark, *rows):
    return spark.createDataFrame([("medio", d, w) for d, w in rows], "city_profile string, dimension_code string, weight string")


def test_default_weights_are_valid(spark):
    defaults = configuration.seed_weights(spark)
    proposed = defaults.withColumn("weight", F.col("weight").cast("string"))
    assert configuration.check_weights(proposed, configuration.seed_dimensions(spark)).count() == 0
    assert defaults.count() == 28


def test_weight_problems(spark):
    dimensions = spark.createDataFrame([("eco",), ("pes",)], "dimension_code string")
    problems = lambda *rows: sorted(r["problem"] for r in configuration.check_weights(weights(spark, *rows), dimensions).collect())
    assert problems(("eco", "60"), ("pes", "40")) == [] and problems(("eco", "60.005"), ("pes", "40")) != []
    assert problems(("eco", "60"), ("pes", "30")) == ["the weights must sum to 100"]
    assert problems(("eco", "100")) == ["give exactly one weight per dimension"]
    assert "give exactly one weight per dimension" in problems(("eco", "50"), ("eco", "50"))
    assert "each weight must be above 0 and at most 100" in problems(("eco", "60"), ("xyz", "40"))


def test_saved_weights_replace_earlier_ones(spark):
    dimensions = spark.createDataFrame([("eco",), ("pes",)], "dimension_code string")
    current = spark.createDataFrame([("medio", "eco", "10"), ("grande", "eco", "1")], "city_profile string, dimension_code string, weight string").withColumn("weight", F.col("weight").cast("decimal(5,2)"))
    good, bad = weights(spark, ("eco", "60"), ("pes", "40")), weights(spark, ("eco", "60"), ("pes", "50"))
    values = lambda df: sorted((r["city_profile"], r["dimension_code"], float(r["weight"])) for r in df.collect())
    assert values(configuration.save_weights(current, good, configuration.check_weights(good, dimensions))) == [("grande", "eco", 1.0), ("medio", "eco", 60.0), ("medio", "pes", 40.0)]
    assert values(configuration.save_weights(current, bad, configuration.check_weights(bad, dimensions))) == [("grande", "eco", 1.0), ("medio", "eco", 10.0)]


def test_audit(spark):
    before = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int")
    after = spark.createDataFrame([("a", 1), ("b", 3), ("d", 4)], "k string, v int")
    got = {r["entity_key"]: (r["operation"], r["old_values"], r["new_values"]) for r in configuration.audit_changes("t", before, after, ["k"], F.lit("2024-01-01").cast("timestamp")).collect()}
    assert set(got) == {"b", "c", "d"} and got["b"][0] == "update" and json.loads(got["d"][2]) == {"k": "d", "v": 4} and got["c"][2] is None


def test_snapshot_is_taken_once(spark):
    history = spark.createDataFrame([], "entity_type string, entity_key string, old_values string, new_values string, changed_at timestamp")
    table = {"t": spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int")}
    now = F.lit("2024-01-01").cast("timestamp")
    once = configuration.save_snapshot(history, "model", table, now)
    twice = configuration.save_snapshot(once, "model", table, now)
    assert json.loads(once.first()["new_values"]) == {"t": [{"k": "a", "v": 1}, {"k": "b", "v": 2}]} and twice.count() == 1


def test_source_rows(spark):
    base = {name: "x" for name in configuration.SOURCE_TEXT_LIMITS}
    row = {**base, "dimension": " ", "code": " eco_11 ", "access": "manual", "official_link": "", "import_url": "https://a", "manual_url": "https://b", "needs": [" a ", "", "b" * 300] + ["c"] * 20}
    schema = ", ".join(f"{k} string" for k in row if k != "needs") + ", needs array<string>"
    df = spark.createDataFrame([tuple(row[k] for k in row if k != "needs") + (row["needs"],)], schema)
    assert configuration.check_sources(df).count() == 0
    clean = configuration.clean_sources(df).first()
    assert (clean["code"], clean["dimension"], clean["import_url"], clean["manual_url"], clean["official_link"]) == ("ECO_11", "Outras", None, "https://b", None)
    assert len(clean["needs"]) == 22 and clean["needs"][0] == "a" and len(clean["needs"][1]) == 300
    cut = configuration.clean_sources(df, longest_need=200, most_needs=10).first()["needs"]
    assert len(cut) == 10 and len(cut[1]) == 200


def test_coverage_merges_spellings_of_a_code(spark):
    rows = [("eco01_a", 10, 20, "2020-01-01", "2021-01-01"), ("eco01_b", 30, 5, "2019-01-01", "2020-01-01"), ("other", 1, 1, "2020-01-01", "2020-01-01")]
    df = spark.createDataFrame(rows, "indicator_code string, municipalities long, value_count long, first_period string, last_period string")
    got = {r["short_code"]: tuple(r)[1:] for r in coverage.coverage_by_code(df).collect()}
    assert got == {"ECO01": (30, 25, "2019-01-01", "2021-01-01"), "OTHER": (1, 1, "2020-01-01", "2020-01-01")}
    items = spark.createDataFrame([("eco01",), ("eco02",)], "code string")
    by_code = coverage.coverage_by_code(df)
    assert [r["code"] for r in coverage.without_data(items, by_code).collect()] == ["eco02"] and coverage.with_data(items, by_code).count() == 1


def test_overrides(spark):
    schema = "code string, position int, dimension string, name string"
    base = spark.createDataFrame([("A", 1, "eco", "a"), ("B", 2, "pes", "b"), ("C", 3, "eco", "c")], schema)
    saved = spark.createDataFrame([("X", 1, "pes", "x"), ("B", 2, "eco", "b2"), ("Y", 3, "new", "y")], schema)
    got = [(r["code"], r["origin"], r["name"]) for r in coverage.in_listing_order(coverage.merge_overrides(base, saved)).collect()]
    assert got == [("A", "base", "a"), ("B", "edited", "b2"), ("C", "base", "c"), ("X", "custom", "x"), ("Y", "custom", "y")]
