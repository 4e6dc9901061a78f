"""Whitening against a plain computation in exact integers and a library's eigenvectors."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import whitening
from quire.llm.queries import QUERIES

EPS = np.finfo(float).eps


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T


MATRICES = {
    "random": np.cov(np.random.default_rng(1).standard_normal((40, 300))),
    "falling": symmetric(10.0 ** -np.arange(30)),
    "equal": symmetric(np.array([5.0] * 6 + [2.0] * 10 + [1.0] * 8)),
    "all equal": np.eye(20) * 3,
    "diagonal": np.diag(np.arange(1.0, 25)),
    "diagonal, equal": np.diag([4.0, 1, 4, 1, 4, 2, 2, 4]),
    "one direction": np.outer(np.arange(1.0, 9), np.arange(1.0, 9)),
    "nearly equal": symmetric(1 + 1e-9 * np.arange(20)),
    "blocks": np.kron(np.eye(5), np.array([[2.0, 1, 0], [1, 2, 1], [0, 1, 2]])),
    "large": symmetric(np.random.default_rng(2).random(200) * 1e12),
    "tiny": symmetric(np.arange(1.0, 18) * 1e-200),
    "one": np.array([[7.0]]),
    "two": np.array([[2.0, 1], [1, 2]]),
}


@pytest.mark.parametrize("name", MATRICES)
def test_components_are_those_of_the_library(name):
    v = MATRICES[name]
    v = (v + v.T) / 2
    values, vectors = whitening.leading_components(v, 16)
    want, of = np.linalg.eigh(v)
    want, of, norm = want[::-1], of[:, ::-1], np.abs(want).max()
    k = len(values)
    assert k == min(16, len(v), int((want > 8 * len(v) * EPS * norm).sum()))
    assert np.abs(values - want[:k]).max() <= 50 * EPS * norm and (np.diff(values) <= 4 * EPS * norm).all()
    assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-10
    assert np.abs(v @ vectors.T - vectors.T * values).max() <= 200 * EPS * norm
    for i in range(k):  # in the library's space of the same eigenvalue
        near = np.abs(want - want[i]) < 1e-6 * norm
        assert np.linalg.norm(of[:, near].T @ vectors[i]) > 1 - 1e-9


def test_tridiagonal_form_is_similar():
    v = MATRICES["random"]
    diagonal, off, h = whitening.tridiagonal(v)
    q = np.eye(len(v))
    for u in h:
        q = q @ (np.eye(len(v)) - 2 * np.outer(u, u))
    assert np.allclose(q.T @ v @ q, np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1), atol=1e-13)
    at = np.linspace(-1, 3, 50)
    assert whitening.sturm_counts(diagonal, off, at).tolist() == [int((np.linalg.eigvalsh(v) < a).sum()) for a in at]


def plain(rows, components=16):
    """{dims: (n, {id: [(deviation, white)...]}, explained, covariance error)} from (id, vector)."""
    usable = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in rows if v and not any(c is None or not math.isfinite(c) for c in v)]
    out = {}
    for d in {len(x) for _, x in usable}:
        fit = sorted({tuple(x) for _, x in usable if len(x) == d})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        y = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], dtype=np.float64) / n
        values, vectors = np.linalg.eigh(y.T @ y / n)
        keep = [k for k in range(d - 1, -1, -1) if values[k] > 8 * d * EPS * values[-1]][:components] if values[-1] > 0 else []
        found = defaultdict(list)
        for i, x in usable:
            if len(x) == d:
                gap = [n * c - s for c, s in zip(x, sums)]
                found[i].append((sum(g * g for g in gap), (np.array(gap, dtype=np.float64) / n) @ vectors[:, keep] / np.sqrt(values[keep])))
        out[d] = n, found, values[keep] / values.sum() if keep else [], np.abs(y @ vectors[:, keep])
    return out


def check(df, rows, components=16):
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in df.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    got = df.collect()
    want = plain(rows, components)
    assert len(got) == sum(len(v) * len(e) for n, f, e, _ in want.values() for v in f.values())
    assert all(r.identity_error <= 1e-4 for r in got)
    for d, (n, found, explained, _) in want.items():
        for i, some in found.items():
            for c in range(1, len(explained) + 1):
                mine = sorted([(r.deviation, abs(r.whitened), r.explained) for r in got if r.vec_id == i and r.component == c and r.n == n], key=str)
                theirs = sorted([(dev, abs(w[c - 1]), explained[c - 1]) for dev, w in some], key=str)
                assert [m[0] for m in mine] == [t[0] for t in theirs] and np.allclose(mine, theirs, rtol=1e-4, atol=1e-6)


def test_query_matches_brute_force(spark, sf):
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    df = QUERIES["op11_whitening"](spark, sf)
    n, found, explained, _ = plain(rows)[64]
    got = defaultdict(dict)
    for r in df.collect():
        got[r.vec_id][r.component] = r
        assert r.n == n and r.identity_error <= 1e-4 and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    assert set(got) == set(found) and all(len(x) == 16 for x in got.values())
    white = {i: np.array([x[c].whitened for c in range(1, 17)]) for i, x in got.items()}
    sign = {c: np.sign(sum(white[i][c] * found[i][0][1][c] for i in white)) for c in range(16)}
    for i, x in got.items():
        assert x[1].deviation == found[i][0][0]
        assert np.allclose(white[i] * [sign[c] for c in range(16)], found[i][0][1], atol=1e-6)


def test_edges(spark, monkeypatch):
    schema, rng = "vec_id long, embedding array<float>, label int, id int, dims int, x int, n int, component int", np.random.default_rng(3)
    frame = lambda rows: spark.createDataFrame([(*r, 0, 1, 2, 3, 4, 5) for r in rows], schema)
    floats = lambda d, scale=1.0: [float(np.float32(c)) for c in rng.standard_normal(d) * scale]
    check(whitening.whiten(frame([])), [])
    check(whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])), [(1, [1.0, 2.0]), (2, [1.0, 2.0])])  # no variance
    rows = [(i, floats(5)) for i in range(40)] + [(7, floats(5)), (3, floats(5))] + [(100 + i, floats(3, 100.0)) for i in range(20)] + [(200 + i, [float(i)]) for i in range(4)]
    rows += [(None, rows[0][1]), (60, rows[1][1]), (61, rows[1][1])]  # copies, and an id that is null
    rows += [(300, None), (301, []), (302, [1.0, float("nan")] + [0.0] * 3), (303, [float("inf")] * 5), (304, [None] * 5), (305, [-float("inf"), 1.0, 1.0])]
    check(whitening.whiten(frame(rows)), rows)
    check(whitening.whiten(frame(rows), 2), rows, 2)
    monkeypatch.setattr(whitening, "BROADCAST", 1)  # a pass for each number of dimensions
    check(whitening.whiten(frame(rows)), rows)


def test_wide_vectors_and_exact_deviation(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(300)]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check(whitening.whiten(df), rows)
    large = [(i, [float(2.0**40 * i), float(i * i)]) for i in range(12)]
    got = whitening.whiten(spark.createDataFrame(large, "vec_id long, embedding array<double>")).where("component = 1").collect()
    x = [[math.floor(64 * c) + 1000000 for c in v] for _, v in large]
    sums = [sum(c) for c in zip(*x)]
    exact = {i: sum((12 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    assert {r.vec_id: r.deviation for r in got} == {i: e if e < 1 << 63 else None for i, e in exact.items()} and any(e >= 1 << 63 for e in exact.values())
    assert math.isclose(got[0].explained, 1, rel_tol=1e-4)


def test_far_centres_keep_the_variance(spark):
    """Entries of a million with a spread of a few: products of what is not centred would lose it."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) / 64 for c in rng.integers(0, 3, size=8)]) for i in range(400)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    check(got, rows)
    assert got.agg(F.max("identity_error")).first()[0] < 1e-12
