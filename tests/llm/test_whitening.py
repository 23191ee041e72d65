import math

import numpy as np
import pytest

from millrace.llm import whitening
from millrace.llm.queries import queries

SF = "/root/testdata/sf0.01"


def brute(vectors, components=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    whole = x * n - s
    y = whole.astype(float) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(values)[::-1][:components]
    return n, (whole**2).sum(axis=1), values[order], axes[:, order], y, values.sum()


def test_query_against_brute_force(spark):
    out = queries()["op11_whitening"](spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, values, axes, y, trace = brute([r.embedding for r in table])
    assert len(out) == n * 32 and set(out["n"]) == {n} and out["identity_error"].nunique() == 1 and out["identity_error"].max() < 1e-9
    wide = out.pivot(index="vec_id", columns="component", values="whitened")
    assert list(wide.index) == [r.vec_id for r in table] and list(wide.columns) == list(range(1, 33))
    want = y @ axes / np.sqrt(values)
    sign = np.sign((want * wide.to_numpy()).sum(axis=0))
    assert np.max(np.abs(want * sign - wide.to_numpy())) < 1e-7
    assert out.groupby("vec_id")["deviation"].first().tolist() == [int(d) for d in deviation]
    assert np.allclose(out.groupby("component")["explained"].first(), values / trace, rtol=1e-12)


@pytest.mark.parametrize("d,kind", [(1, "plain"), (2, "plain"), (7, "plain"), (40, "plain"), (40, "low rank"), (30, "repeated"), (24, "diagonal"), (16, "zero"), (33, "graded"), (21, "wilkinson")])
def test_eigenpairs(d, kind):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = {
        "plain": rng.random(d), "low rank": np.where(np.arange(d) < 5, 1.0, 0), "repeated": np.repeat([3.0, 2.0, 1.0], d // 3 + 1)[:d], "diagonal": np.arange(d) // 2 + 1.0,
        "zero": np.zeros(d), "graded": 10.0 ** -np.arange(d), "wilkinson": np.ones(d),
    }[kind]
    a = np.diag(values) if kind == "diagonal" else (q * values) @ q.T
    if kind == "wilkinson":  # pairs of eigenvalues that agree to 14 digits
        a = np.diag(np.abs(np.arange(d) - d // 2).astype(float)) + np.diag(np.ones(d - 1), 1) + np.diag(np.ones(d - 1), -1)
    a = (a + a.T) / 2
    got, vectors = whitening.eigenpairs(a, d)
    norm = max(np.linalg.norm(a, 2), 1e-300)
    assert np.max(np.abs(got - np.linalg.eigvalsh(a)[::-1])) <= 1e-13 * norm * d
    assert np.max(np.abs(a @ vectors - vectors * got)) <= 1e-13 * norm * d
    assert np.max(np.abs(vectors.T @ vectors - np.eye(d))) < 1e-12 * d


def test_tridiagonal_and_sturm_counts():
    a = np.random.default_rng(3).standard_normal((12, 12))
    a = a + a.T
    diagonal, off, q = whitening.tridiagonal(a)
    t = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    assert np.allclose(q @ t @ q.T, a) and np.allclose(q.T @ q, np.eye(12))
    at = np.linspace(-8, 8, 33)
    assert whitening.sturm_counts(diagonal, off, at).tolist() == [(np.linalg.eigvalsh(a) < x).sum() for x in at]


SCHEMA = "vec_id long, embedding array<double>, whitened string"


def test_rows_that_go_and_rows_that_stay(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -3.25]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [-inf, 0.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [4.0, 0.01])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    done, summary = whitening.whiten(df)
    assert sorted((r.vec_id or 0) for r in done.collect()) == [0, 1, 1, 9]
    n, deviation, values, axes, y, trace = brute([[1, 2], [1, 2], [0.5, -3.25], [4, 0.01]])
    assert sorted(r.deviation for r in done.collect()) == sorted(int(d) for d in deviation)
    s = summary.first()
    assert s.n == 4 and np.allclose(s.explained, values / trace) and s.identity_error < 1e-10
    out = whitening.long_form(done, summary)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 8


def test_empty_one_and_equal_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.long_form(*whitening.whiten(empty)).collect() == []
    for vectors in ([[1.0, 2.0]], [[1.0, 2.0]] * 5):
        rows = whitening.long_form(*whitening.whiten(spark.createDataFrame([(i, v, "") for i, v in enumerate(vectors)], SCHEMA))).collect()
        assert len(rows) == 2 * len(vectors) and {(r.whitened, r.explained, r.deviation, r.identity_error) for r in rows} == {(None, None, 0, None)}
    # the second dimension is twice the first: one direction, the other component has none
    rows = whitening.long_form(*whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], "") for i in range(9)], SCHEMA))).collect()
    assert {r.component for r in rows if r.whitened is None} == {2} and rows[0].identity_error < 1e-10 and len(rows) == 18


def test_very_large_entries(spark):
    rows = [(1, [1e300, 1.0], ""), (2, [-1e300, 2.0], ""), (3, [2.0**30, 0.0], "")]
    assert whitening.long_form(*whitening.whiten(spark.createDataFrame(rows, SCHEMA))).count() == 6


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(1, [4.0e7], ""), (2, [-4.0e7], ""), (3, [0.0], "")]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA))[0].collect()}
    assert got == {1: None, 2: None, 3: 0}
