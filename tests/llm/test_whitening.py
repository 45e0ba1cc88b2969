"""Whitening against dense linear algebra, exact sums and hand-made spectra."""

import numpy as np
import pytest

from opsmeter.llm import queries, whitening
from opsmeter.llm.whitening import Factors, Spectrum

SF = "/root/testdata/sf0.01"


def matrix(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    a = (q * np.array(values, float)) @ q.T
    return (a + a.T) / 2


SPECTRA = {
    "spread": np.linspace(1, 100, 40),
    "close": [*np.linspace(1, 2, 30), 50, 50 + 1e-9, 50 + 2e-9, 60, 60],
    "equal": [7.0] * 12,
    "wide": np.geomspace(1e-12, 1e4, 30),
    "both signs": np.linspace(-30, 20, 25),
    "one": [3.0],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_leading_components(name):
    a = matrix(SPECTRA[name])
    expected = np.sort(np.linalg.eigvalsh(a))[::-1]
    found = Spectrum(a).leading(8)
    positive = int((expected > 1e-10 * abs(expected).max()).sum())
    assert len(found) == min(8, positive)
    vectors = np.array([c.vector for c in found])
    scale = abs(expected).max()
    assert np.allclose([c.value for c in found], expected[: len(found)], rtol=0, atol=1e-13 * scale)
    assert np.allclose(vectors @ vectors.T, np.eye(len(found)), atol=1e-12)
    for c in found:
        assert np.linalg.norm(a @ c.vector - c.value * c.vector) < 1e-13 * scale


def test_zero_and_missing_ranks():
    assert Spectrum(np.zeros((5, 5))).leading(8) == []
    assert len(Spectrum(matrix([0, 0, 0, 1, 2, 3])).leading(8)) == 3


@pytest.mark.parametrize("seed", range(6))
def test_signs_of_the_factors_count_eigenvalues(seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(15, 15))
    a = a + a.T
    if seed % 2:  # nothing on the diagonal: pivots of two
        np.fill_diagonal(a, 0)
    factors = Factors(a)
    assert factors.positive() == (np.linalg.eigvalsh(a) > 0).sum()
    right = rng.normal(size=15)
    assert np.allclose(a @ factors.solve(right, 0.0), right)


def plain(vectors, components=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(int) + 100_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    deviations = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return centred @ axes / np.sqrt(values), values / np.trace(covariance), deviations


def test_all_embeddings(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    scores, explained, deviations = plain([r.embedding for r in table])
    rows = queries.op11_embedding_whitening(spark, SF).collect()
    assert len(rows) == 8 * len(table)
    got = {(r.vec_id, r.component): r for r in rows}
    for k in range(8):
        column = np.array([got[r.vec_id, k + 1].whitened for r in table])
        assert min(abs(column - scores[:, k]).max(), abs(column + scores[:, k]).max()) < 1e-9
    for r, deviation in zip(table, deviations):
        assert got[r.vec_id, 1].deviation == deviation and got[r.vec_id, 1].n == len(table)
    assert np.allclose([got[0, k + 1].explained for k in range(8)], explained, rtol=1e-12)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=3).tolist()) for i in range(20)]
    good += [(None, good[0][1]), (3, good[3][1]), (3, good[3][1])]
    bad = [
        (100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]),
        (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (106, [0.0, -(2.0**41), 0.0]),
    ]
    names = ["component", "n", "deviation", "whitened", "entries", "scores", "place", "size", "cell", "value"]
    data = [(i, v, *["x"] * len(names)) for i, v in good + bad]
    schema = "vec_id bigint, embedding array<double>, " + ", ".join(f"`{n}` string" for n in names)
    rows = whitening.whitened(spark.createDataFrame(data, schema)).collect()
    scores, explained, deviations = plain([v for _, v in good], 3)
    assert len(rows) == 3 * len(good)
    assert sorted(r.deviation for r in rows if r.component == 1) == sorted(deviations)
    assert sorted({r.component for r in rows}) == [1, 2, 3] and all(r.n == len(good) for r in rows)
    for k in range(3):
        got = sorted(abs(r.whitened) for r in rows if r.component == k + 1)
        assert np.allclose(got, sorted(abs(scores[:, k])), atol=1e-9)
    assert rows[0].identity_error < 1e-10


def test_large_entries_stay_exact(spark):
    vectors = [[1e9 + i * 0.25, -3e8 * i, 5.0 * i * i] for i in range(7)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id int, embedding array<double>")
    rows = whitening.whitened(frame, components=1).collect()
    _, _, deviations = plain(vectors, 1)
    assert {r.vec_id: r.deviation for r in rows} == {
        i: d if d < 2**63 else None for i, d in enumerate(deviations)
    }


def test_no_variance_and_no_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    for data in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        frame = whitening.whitened(spark.createDataFrame(data, schema))
        assert frame.collect() == []
        assert frame.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, abs(r.whitened), r.explained) for r in rows) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
