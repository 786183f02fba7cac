import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from civigrade.llm import mixing


def rows_of(spark, sizes, seed=0):
    """Documents of 1 to 9 tokens for each source until its tokens are spent."""
    rows, doc_id = [], 0
    for source, tokens in sizes.items():
        while tokens > 0:
            n = min(tokens, 1 + (doc_id * 7 + seed) % 9)
            rows.append((doc_id, source, n))
            tokens -= n
            doc_id += 1
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    return df.withColumn("draw_key", F.xxhash64("doc_id"))


def bisected(sizes, goal, target):
    total = sum(sizes.values())
    shares = [n / total for n in sizes.values()]

    def value(x):
        if goal == "repetition":
            ratios = [s ** (x - 1) for s in shares]
            return max(ratios) / min(ratios)
        powers = [s**x for s in shares]
        return -sum(p / sum(powers) * math.log(p / sum(powers)) for p in powers)

    low, high = 0.0, 1.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) >= target else (low, middle)
    return low


SIZES = {"big": 9_000, "middle": 1_500, "small": 300, None: 120}


@pytest.mark.parametrize(("goal", "target"), [("repetition", 2.0), ("repetition", 1.25), ("entropy", 1.0), ("entropy", 0.8)])
def test_exponent(spark, goal, target):
    rows = rows_of(spark, SIZES)
    totals = mixing.source_totals(rows).withColumn("all_tokens", F.lit(sum(SIZES.values())).cast("long"))
    assert abs(mixing.exponent_for(totals, goal, target) - bisected(SIZES, goal, target)) < 1e-6


def test_ends_of_the_interval(spark):
    totals = mixing.source_totals(rows_of(spark, SIZES)).withColumn("all_tokens", F.lit(sum(SIZES.values())).cast("long"))
    assert mixing.exponent_for(totals, "repetition", 1e9) == 0.0
    assert mixing.exponent_for(totals, "repetition", 1.0) == 1.0
    assert mixing.exponent_for(totals, "entropy", 99.0) == 0.0
    assert mixing.exponent_for(totals, "entropy", 0.0) == 1.0


@pytest.mark.parametrize("budget", [None, 4_000, 30_000])
def test_budgets_are_met(spark, budget):
    rows = rows_of(spark, SIZES)
    out = mixing.drawn(rows, "repetition", 2.0, budget).collect()
    exponent = bisected(SIZES, "repetition", 2.0)
    total = sum(SIZES.values())
    powers = {s: (n / total) ** exponent for s, n in SIZES.items()}
    weights = {s: p / sum(powers.values()) for s, p in powers.items()}
    whole = budget or max(SIZES[s] / weights[s] for s in SIZES)
    for source, size in SIZES.items():
        own = [r for r in out if r.source == source]
        assert abs(sum(r.n_tokens for r in own) - weights[source] * whole) < 10
        assert all(abs(r.weight - weights[source]) < 1e-6 for r in own)
        epochs = Counter(r.epoch for r in own)
        documents = rows.filter(F.col("source").eqNullSafe(F.lit(source))).count()
        assert all(epochs[e] == documents for e in range(math.floor(round(weights[source] * whole / size, 6))))
        assert max(Counter((r.doc_id, r.epoch) for r in own).values()) == 1
    if budget is None:
        assert {r.doc_id for r in out} == {r.doc_id for r in rows.collect()}
        assert max(Counter(r.doc_id for r in out).values()) <= 2


def test_epochs_are_different_permutations(spark):
    out = mixing.drawn(rows_of(spark, {"a": 2_000, "b": 20}), "repetition", 1.0, 6_060).collect()
    orders = {e: [r.doc_id for r in sorted((r for r in out if r.source == "a" and r.epoch == e), key=lambda r: (r.block_rank, r.place_key))] for e in (0, 1, 2)}
    assert sorted(orders[0]) == sorted(orders[1]) == sorted(orders[2]) and orders[0] != orders[1] != orders[2]


def test_odd_documents(odd_documents):
    out = mixing.mixture(odd_documents)
    assert out.columns == odd_documents.columns
    before, after = (Counter((r.doc_id, r.text) for r in df.collect()) for df in (odd_documents, out))
    assert set(before) == set(after)
    assert all(before[k] <= after[k] <= 2 * before[k] for k in before)


def test_words(cells):
    texts = ["a b", " ", None, "", "ñ\tü\n x", "one"]
    assert cells(mixing.words_in, texts) == [2, 0, 0, 0, 3, 1]


def test_empty_table_and_texts_without_words(spark, no_documents):
    assert mixing.mixture(no_documents).count() == 0
    docs = spark.createDataFrame([(1, "", "a"), (2, None, "b"), (3, " ", None)], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in mixing.mixture(docs).collect()) == [1, 2, 3]
