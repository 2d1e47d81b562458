"""Whitening against exact fractions and a direct decomposition."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from driftloom.llm.queries import op12_embedding_whitening
from driftloom.llm.whitening import exact_sums, fit_whitening, scaled_vectors, whiten_embeddings

SCHEMA = "vec_id long, embedding array<float>"


def exact(vectors):
    """n, sums, and the covariance as a matrix of fractions' nearest doubles."""
    x = [[floor(1024 * Fraction(float(np.float32(c)))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(row[k] for row in x) for k in range(d)]
    y = [[n * row[k] - sums[k] for k in range(d)] for row in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    return n, y, cov


def compare(rows, got, k=8):
    sound = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, y, cov = exact([v for _, v in sound])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    want = np.array(y, float) / n @ vectors / np.sqrt(values)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(by) == len(sound)
    signs = np.sign(sum(want[a] * np.array([by[i][c + 1]["whitened"] for c in range(k)]) for a, (i, _) in enumerate(sound)))
    for a, (i, _) in enumerate(sound):
        assert sorted(by[i]) == list(range(1, k + 1))
        for c in range(k):
            r = by[i][c + 1]
            assert r["n"] == n and r["deviation"] == sum(v * v for v in y[a])
            assert r["whitened"] == pytest.approx(signs[c] * want[a][c], abs=1e-6)
            assert r["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-9) and r["identity_error"] < 1e-9


def table_of(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    return op12_embedding_whitening(spark, str(tmp_path)).collect()


def test_query_equals_exact_arithmetic(spark, tmp_path):
    rng = np.random.default_rng(3)
    scale = np.array([40, 9, 7, 5, 3, 2, 1, 0.5, 0.25, 0.1, 1e-2, 5])
    rows = [(i, [float(c) for c in rng.normal(size=12) * scale]) for i in range(150)]
    rows += [(200, None), (201, [1.0, None] + [0.0] * 10), (202, [float("nan")] * 12), (203, [float("inf")] + [0.0] * 11), (204, [float("-inf")] + [0.0] * 11)]
    rows += [(300 + i, rows[0][1]) for i in range(90)]
    compare(rows, table_of(spark, tmp_path, rows))


def test_query_on_the_given_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(rows, op12_embedding_whitening(spark, "/root/testdata/sf0.001").collect())


def test_few_dimensions_and_no_variance(spark, tmp_path):
    rows = [(i, [float(i), float(2 * i), 7.0]) for i in range(20)]  # rank one
    got = table_of(spark, tmp_path, rows)
    assert {r["component"] for r in got} == {1} and len(got) == 20
    assert got[0]["explained"] == pytest.approx(1) and got[0]["identity_error"] < 1e-9
    same = whiten_embeddings(spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], SCHEMA)).collect()
    assert [r["whitened"] for r in same] == [[], []] and {r["deviation"] for r in same} == {0}


def test_empty_tables_null_ids_and_clashing_columns(spark):
    assert whiten_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten_embeddings(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0
    assert [r["whitened"] for r in whiten_embeddings(spark.createDataFrame([(1, []), (2, [])], SCHEMA)).collect()] == [[], []]
    odd = spark.createDataFrame([(None, [1.0, 0.0], "x", 1), (None, [0.0, 5.0], "y", 2), (None, [9.0, 5.0], "y", 2)], "vec_id long, _x array<double>, n string, deviation int")
    rows = whiten_embeddings(odd, vec_col="_x").collect()
    assert len(rows) == 3 and {r["n"] for r in rows} == {3} and all(len(r["whitened"]) == 2 for r in rows)
    with pytest.raises(Exception, match="differ in length"):
        whiten_embeddings(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA)).count()


def test_entries_no_long_could_hold(spark):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 4.0])]
    scaled = scaled_vectors(spark.createDataFrame(rows, SCHEMA))
    n, sums = exact_sums(scaled)
    assert n == 3 and sums == [300_000, 7 * 1024 + 300_000]
    got = {r["vec_id"]: r for r in whiten_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["deviation"] is None and got[3]["deviation"] == (3 * 4 * 1024 - 7 * 1024) ** 2  # 0 in the first


def test_small_spread_on_a_large_offset(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(c)) for c in 2.0**20 + rng.integers(0, 3, 3)]) for i in range(400)]
    fit = fit_whitening(scaled_vectors(spark.createDataFrame(rows, SCHEMA)))
    _, _, cov = exact([v for _, v in rows])
    assert fit.values == pytest.approx(np.linalg.eigvalsh(cov)[::-1], rel=1e-12)
