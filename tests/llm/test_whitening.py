import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from civigrade.llm import whitening
from civigrade.llm.catalog import table

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def compared(rows, given, components=4):
    """Every row against a dense eigenvalue problem over the distinct lattice vectors."""
    whole = [(i, v) for i, v in given if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(256 * float(c)) for c in v] for _, v in whole]
    fit = sorted({tuple(v) for v in x})
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-10 * values[0]).sum()))
    assert len(rows) == k * len(whole)
    by_row = {}
    for row in rows:
        by_row.setdefault((row.vec_id is None, row.vec_id or 0, row.deviation), []).append(row)
    signs = {}
    for (i, _), v in sorted(zip(whole, x), key=str):
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        own = by_row[(i is None, i or 0, deviation)]
        for row in own:
            c = row.component - 1
            expected = (np.array(v, float) - np.array(sums) / n) @ vectors[:, c] / math.sqrt(values[c])
            assert row.n == n and abs(row.explained - values[c] / values.sum()) < 1e-9 and row.identity_error < 1e-9
            if abs(expected) > 1e-6:
                signs.setdefault(c, round(row.whitened / expected))
                assert row.whitened == pytest.approx(signs[c] * expected, rel=1e-6, abs=1e-8)
    assert set(signs.values()) <= {1, -1}


def test_real_vectors(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    found = whitening.whitened(vectors)
    assert found.columns == COLUMNS
    compared(found.collect(), [(r.vec_id, r.embedding) for r in vectors.collect()])


def odd(spark, extra=()):
    chance = np.random.default_rng(3)
    rows = [(i, [float(c) for c in chance.normal(size=6) * [3, 2, 1.5, 1, 0.5, 0.1]], "m") for i in range(60)]
    rows += [rows[0], rows[1], (100, rows[2][1], "x"), (None, rows[3][1], "x"), (None, [9.0] * 6, "x")]
    rows += [(200, None, "x"), (201, [], "x"), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (203, [math.nan] * 6, "x"), (204, [math.inf] + [0.0] * 5, None), (205, [-0.0] * 6, "x"), *extra]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string"), rows


def test_odd_vectors(spark):
    vectors, rows = odd(spark)
    compared(whitening.whitened(vectors).collect(), [(i, v) for i, v, _ in rows])


def test_vectors_of_another_length_are_left_out(spark):
    vectors, rows = odd(spark, [(300, [1.0, 2.0], "x")])
    found = whitening.whitened(vectors).collect()
    assert 300 not in {r.vec_id for r in found}
    compared(found, [(i, v) for i, v, _ in rows if i != 300])


def test_low_rank_and_none(spark):
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "vec_id long, embedding array<float>")
    found = whitening.whitened(line).collect()
    assert {r.component for r in found} == {1} and len(found) == 5
    compared(found, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])
    same = line.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    assert whitening.whitened(same).collect() == [] and whitening.whitened(line.filter("vec_id < 0")).collect() == []


def test_equal_and_close_eigenvalues():
    chance = np.random.default_rng(5)
    frame = np.linalg.qr(chance.standard_normal((40, 40)))[0]
    for spectrum in ([5, 5, 5, 5, 5] + [1] * 35, [5, 5 - 1e-9, 4, 4 - 1e-12] + [3.999] * 36, [1.0] * 40, [7] + [0] * 39, list(np.geomspace(1, 1e-12, 40))):
        operator = frame * np.array(spectrum, float) @ frame.T
        values, vectors = whitening.jacobi_davidson(lambda u, operator=operator: operator @ u, 40, 4)
        assert np.allclose(values, sorted(spectrum, reverse=True)[:4], rtol=0, atol=1e-13 * spectrum[0])
        assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-14
        assert np.linalg.norm(operator @ vectors - vectors * values, axis=0).max() < 2e-13 * spectrum[0]


def test_exact_deviations():
    x = np.array([[3, -(1 << 20)], [5, 1 << 20], [0, 0]])
    for n, sums in ((10, [8, 0]), (1 << 19, [3, 1 << 38]), (1 << 41, [1 << 50, -(1 << 60)])):
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
        assert list(whitening.deviations(x, n, sums)) == [e if e < 1 << 63 else None for e in exact]
    assert whitening.deviations(np.array([[1, 4]]), 1 << 31, [3, 1 << 33]) == [(2**31 - 3) ** 2]


def test_large_entries_are_refused(spark):
    with pytest.raises(ValueError):
        whitening.whitened(spark.createDataFrame([(1, [1e9]), (2, [0.0])], "vec_id long, embedding array<double>"))
