"""Hot keys, large lookups and numbering: the ways taken beyond the bounds give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from civigrade.operators import geography, index, joins, publication
from civigrade.plans import catalog
from civigrade.sources import tables


@pytest.fixture(scope="module")
def hot_rows(spark):
    """90,000 rows, a third of them with one key, some without a key."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise((F.col("id") % 1000).cast("string"))
    return spark.range(90_000).select("id", key.alias("key"))


def test_attach_counted(hot_rows):
    counts = hot_rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    got = joins.attach_counted(hot_rows, counts, ["key"])
    assert got.columns == ["id", "key", "n", "last"]
    facts = [F.count(F.lit(1)), F.count_distinct("id"), F.sum("n"), F.sum("last")]
    same = hot_rows.join(counts.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")))
    assert got.agg(*facts).first() == same.agg(*facts).first()
    assert joins.attach_counted(hot_rows, counts, ["key"], null_keys=False).count() == hot_rows.filter("key IS NOT NULL").count()


def test_rows_of_a_hot_key_are_split(spark, hot_rows):
    """The partition of the key with a third of all rows is read by many tasks."""
    keep = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    before = {key: spark.conf.get(key, None) for key in keep}
    for key, value in keep.items():
        spark.conf.set(key, value)
    try:
        counts = hot_rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        got = joins.attach_counted(hot_rows.repartition(12), counts, ["key"]).withColumn("task", F.spark_partition_id())
        assert got.filter("key = 'hot'").select("task").distinct().count() > 1
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def jobs_of(spark, build):
    """What ``build`` returns and how many jobs ran while it did."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        result = build()
        return result, len(tracker.getJobIdsForGroup("planning"))
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_lookup_is_bounded_by_the_plan(spark, tmp_path):
    spark.range(2000).withColumn("text", F.repeat(F.lit("x"), F.lit(100))).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    small, jobs = jobs_of(spark, lambda: joins.lookup(stored))
    assert hinted(small) and jobs == 0
    assert not hinted(joins.lookup(stored, size=1000))
    assert not hinted(joins.lookup(stored.join(stored.withColumnRenamed("text", "t2"), "id").join(spark.range(10**9), "id")))


def test_lookup_counts_what_is_held_in_memory(spark, tmp_path):
    """Files are compressed, and statistics take an unfolded array for one row."""
    spark.range(2000).withColumn("text", F.repeat(F.lit("x"), F.lit(100))).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    planned = joins.planned_bytes(stored)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(joins.lookup(stored, size=planned * joins.HELD_FOR_PLANNED)) and not hinted(joins.lookup(stored, size=planned * 2))
    years, ids = F.array(*[F.lit(y) for y in range(50)]), F.array(*[F.col("id") + y for y in range(50)])
    for array in (years, ids):
        many, jobs = jobs_of(spark, lambda: joins.lookup(stored.withColumn("y", F.explode(array)), size=planned * joins.HELD_FOR_PLANNED * 40))
        assert not hinted(many) and jobs == 0
        assert hinted(joins.lookup(stored.withColumn("y", F.explode(array)), size=planned * joins.HELD_FOR_PLANNED * 60))
    assert not hinted(joins.lookup(stored.withColumn("y", F.explode(F.sequence(F.lit(1), F.col("id") + 1)))))


def test_what_is_too_large_is_not_broadcast_by_the_size_of_its_file(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    wide = spark.read.parquet(str(tmp_path / "t")).withColumn("y", F.explode(F.array(*[F.lit(y) for y in range(1500)])))
    assert joins.planned_bytes(wide) < 1 << 20 < joins.BROADCAST_BYTES < joins.held_bytes(wide)
    found = spark.range(10).join(joins.lookup(wide), "id")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 15_000


@pytest.fixture(scope="module")
def general_tables(spark, tmp_path_factory):
    """Small general tables: codes that are unknown, spelled in all ways, places that share names, prices that are missing."""
    folder = str(tmp_path_factory.mktemp("general"))
    line = F.col("id")
    tables_of = {
        "nation": spark.range(3).select(line.alias("n_nationkey"), F.concat(F.lit("NATION_"), line).alias("n_name")),
        "customer": spark.range(40).select(line.alias("c_custkey"), F.concat(F.lit("Customer "), line).alias("c_name"), (line % 3).alias("c_nationkey"), (line * 7.5).alias("c_acctbal")),
        "part": spark.range(60).select(line.alias("p_partkey"), F.concat(F.lit("red part "), (line % 20).cast("string")).alias("p_name"), F.concat(F.lit("Brand#"), line % 4 + 11).alias("p_brand")),
        "lineitem": spark.range(600).select(
            (line / 7).cast("long").alias("l_orderkey"), (line % 7 + 1).cast("int").alias("l_linenumber"), (line * 11 % 60).alias("l_partkey"),
            (line * 3.25).alias("l_extendedprice"), F.when(line % 9 == 0, 0.0).otherwise(0.05).alias("l_tax"), (line % 50 + 1).cast("double").alias("l_quantity"),
            F.lit(0.04).alias("l_discount"), F.to_timestamp(F.date_add(F.lit("1995-01-01").cast("date"), (line * 5).cast("int"))).alias("l_shipdate"),
            F.when(line % 2 == 0, "A").otherwise("R").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
        ),
    }
    for name, rows in tables_of.items():
        rows.write.parquet(f"{folder}/{name}.parquet")
    return folder


LARGE_LOOKUPS = {"r4_q2_prepare_batch": "inhabitants", "q2_problem_counts": "inhabitants", "w8_problem_samples": "inhabitants", "g7_check_matches": "name_key"}


@pytest.mark.parametrize("name", LARGE_LOOKUPS)
def test_a_lookup_that_unfolds_beyond_memory_is_shuffled(spark, general_tables, monkeypatch, name):
    """Files of 2 MB by the statistics whose rows are unfolded: they were broadcast, whatever they hold; the rows stay the same."""
    seen, real = [], F.broadcast
    monkeypatch.setattr(joins.F, "broadcast", lambda df: seen.append(df.columns) or real(df))
    rows = lambda: sorted(map(str, catalog.QUERIES[name](spark, general_tables).collect()))
    expected = rows()
    assert expected and any(LARGE_LOOKUPS[name] in columns for columns in seen)
    seen.clear()
    monkeypatch.setattr(joins, "planned_bytes", lambda df: 2 << 20)
    assert rows() == expected
    assert not any(LARGE_LOOKUPS[name] in columns for columns in seen)


def test_codes_resolve_the_same_without_broadcast(spark, monkeypatch):
    catalog = spark.range(1000).select(F.format_string("%07d", F.col("id") * 10 + F.col("id") % 10).alias("ibge_code"))
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit("000001")).otherwise(F.format_string("%07d", F.col("id"))).alias("cell"))
    resolved, jobs = jobs_of(spark, lambda: geography.resolve_codes(rows, F.col("cell"), catalog))
    assert jobs == 0
    total = lambda df: df.agg(F.count("municipality_code"), F.sum(F.hash("municipality_code"))).first()
    with_broadcast = total(resolved)
    monkeypatch.setattr(joins, "planned_bytes", lambda df: 1 << 62)
    plan = geography.resolve_codes(rows, F.col("cell"), catalog)
    assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()
    assert total(plan) == with_broadcast


@pytest.mark.parametrize("block", [7, 1000])
def test_row_numbers(spark, monkeypatch, block):
    monkeypatch.setattr(joins, "NUMBERING_BLOCK", block)
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, "big").otherwise("small").alias("g"), (F.col("id") * 7 % 3001).alias("p"), F.explode(F.array(F.lit(1), F.lit(2))).alias("t")
    )
    numbered = joins.number_rows(rows, ["g"], "p", ["t"], "n")
    by_rank = rows.withColumn("n", F.row_number().over(joins.Window.partitionBy("g").orderBy("p", "t")))
    assert numbered.exceptAll(by_rank.select(*numbered.columns)).count() == 0 and numbered.count() == 6000


def test_ranks_of_large_ties(spark):
    rows = spark.range(50_000).select("id", F.when(F.col("id") % 3 == 0, 100.0).otherwise(F.round(F.pmod(F.xxhash64("id"), F.lit(9_999_999)) / 100000.0, 4)).alias("score"))
    ranked = index.competition_rank(rows, F.col("score"))
    expected = rows.withColumn("rank", F.rank().over(joins.Window.orderBy(F.desc("score"))).cast("long"))
    assert ranked.select("id", "rank").exceptAll(expected.select("id", "rank")).count() == 0 and ranked.count() == 50_000


def test_scores_that_differ_in_the_last_place(spark):
    rows = spark.createDataFrame([("a", 90.0000000002), ("b", 90.0000000001), ("c", 90.0000000001), ("d", 1e9), ("e", -5.0), ("f", None)], "k string, s double")
    assert {r["k"]: r["rank"] for r in index.competition_rank(rows, F.col("s")).collect()} == {"d": 1, "a": 2, "b": 3, "c": 3, "e": 5}


def test_no_task_sees_all_rows_when_ranking(spark):
    """The only window without a partition runs over the sums of ranges of scores, not over rows."""
    rows = spark.range(1000).select("id", (F.col("id") % 100).cast("double").alias("score"))
    plan = index.competition_rank(rows, F.col("score"))._jdf.queryExecution().optimizedPlan().toString()
    assert "_range_rows" in plan and "CartesianProduct" not in plan


def test_one_municipality_with_a_third_of_all_rows(spark):
    """Duplicates of one hot key are all found, and none of them is published."""
    rows = spark.range(30_000).select(
        F.lit("imp").alias("import_id"), F.lit("ind").alias("indicator_code"), F.lit("A").alias("sheet_name"), F.col("id").alias("row_number"),
        F.when(F.col("id") % 3 == 0, "1111111").otherwise(F.format_string("%07d", F.col("id"))).alias("municipality_code"),
        F.struct(F.lit(2023).alias("year"), F.lit(1).alias("month")).alias("period"), F.col("id").cast("decimal(38,10)").alias("value"), F.lit("u").alias("unit"),
    )
    marked = publication.mark_duplicates(publication.prepared_candidates(rows))
    assert marked.filter("duplicate_count = 10000").count() == 10_000 and marked.filter("duplicate_count = 1").count() == 20_000


def test_latest_limits_rows_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id"), F.current_date().alias("period"))
    plan = joins.latest(rows, ["k"], "period", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_upsert_keeps_the_last_writer(spark):
    current = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, at int")
    incoming = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, at int")
    got = sorted((r["k"], r["v"]) for r in joins.upsert(current, incoming, ["k"], ["at"]).collect())
    assert got == [("a", 1), ("b", 4), ("c", 5)]


def test_scratch_folders_go_when_a_job_is_done(spark, monkeypatch):
    from pathlib import Path

    from civigrade import session

    monkeypatch.setattr(session, "_made", {})
    table = session.materialise(spark.range(5), "short-lived")
    folder = Path(table.inputFiles()[0].removeprefix("file://").removeprefix("file:")).parent
    assert folder.exists() and session.clear_scratch(spark) == 1 and not folder.exists()
    assert session.clear_scratch(spark) == 0


@pytest.mark.parametrize("most", [20_000, 3])
def test_few_rows_of_each_key_are_kept_without_a_sort(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "MOST_HELD", most)
    chance = random.Random(5)
    rows = [(chance.choice(["a", "b", None]), chance.choice([None, 1, 2, 3]), chance.choice(["x", None, "ção"])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, n long, t string").repartition(3)
    few = joins.few_per_key(df, ["k"], ["n", "t"], 4)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "WindowGroupLimit" not in plan
    found = joins.first_per_key(few, ["k"], F.col("n"), F.col("t"), rows=4).collect()
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode())
    expected = [r for k in ("a", "b", None) for r in sorted((r for r in rows if r[0] == k), key=order)[:4]]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert joins.few_per_key(df.filter("false"), ["k"], ["n", "t"], 4).collect() == []


def test_large_staged_tables_are_sorted_by_many_tasks(spark, stage_rows, tmp_path, monkeypatch):
    rows = stage_rows([{"a": str(i)} for i in range(300)])
    monkeypatch.setattr(tables, "STAGED_TASK_BYTES", 100)
    monkeypatch.setattr(tables, "MOST_STAGED_TASKS", 24)
    tables.write_staged(rows, str(tmp_path / "staged"), rows_per_file=10)
    files = list((tmp_path / "staged").rglob("part-*.parquet"))
    assert len(files) > 8
    assert spark.read.parquet(str(tmp_path / "staged")).count() == 300
