import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from provlake.llm import whitening
from provlake.llm.eigen_update import Spectrum, rank_one


def plain(vectors):
    """Whitening of (vec_id, embedding) rows by one dense eigendecomposition."""
    width = max((len(e) for _, e in vectors if e), default=0)
    rows = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in e]) for i, e in vectors
            if e and len(e) == width and all(c is not None and math.isfinite(c) for c in e)]
    fit = np.array(sorted({tuple(x) for _, x in rows}), dtype=float)
    n, sums = len(fit), [sum(c) for c in zip(*{tuple(x) for _, x in rows})]
    off = fit - np.array([s / n for s in sums])
    values, vec = np.linalg.eigh(off.T @ off / n)
    keep = [k for k in range(width - 1, -1, -1) if values[k] > 1e-12 * values.sum()][:16]
    return rows, n, sums, values[keep], vec[:, keep], values.sum()


def compare(got, vectors):
    rows, n, sums, values, vec, trace = plain(vectors)
    assert len(got) == len(rows) * len(values)
    x = {i: np.array(e, dtype=float) for i, e in rows}
    dev = {i: sum((n * v - s) ** 2 for v, s in zip(e, sums, strict=True)) for i, e in rows}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-9
    for c in range(len(values)):
        mine = [r for r in got if r.component == c + 1]
        want = np.array([(x[r.vec_id] - np.array([s / n for s in sums])) @ vec[:, c] / np.sqrt(values[c]) for r in mine])
        have = np.array([r.whitened for r in mine])
        sign = np.sign(have @ want)
        assert np.allclose(have * sign, want, atol=1e-7), c
        assert all(r.n == n and r.deviation == dev[r.vec_id] for r in mine)
        assert all(abs(r.explained - values[c] / trace) <= 1e-10 * r.explained for r in mine)


@pytest.mark.parametrize("kind", ["random", "equal", "low_rank", "far_apart"])
def test_updates_equal_a_dense_decomposition(kind):
    rnd, width = np.random.default_rng(3), 12
    x = {"random": rnd.normal(size=(300, width)), "equal": np.repeat(np.eye(width), 3, axis=0), "low_rank": rnd.normal(size=(80, 3)) @ rnd.normal(size=(3, width)),
         "far_apart": rnd.normal(size=(200, width)) * 10.0 ** np.arange(-6, 6)}[kind]
    parts = []
    for part in np.array_split(x, 4):
        s = Spectrum(width)
        for row in part:
            s.add(row)
        parts.append(Spectrum.from_bytes(s.to_bytes(), width))
    whole = parts[0]
    for s in [*parts[1:], Spectrum(width)]:
        whole.merge(s)
    off = x - x.mean(axis=0)
    scatter = off.T @ off
    assert whole.n == len(x) and np.allclose(whole.mean, x.mean(axis=0), atol=1e-12 * abs(x).max())
    assert np.allclose(whole.q.T @ whole.q, np.eye(width), atol=1e-10)
    assert np.allclose(whole.q * whole.d @ whole.q.T, scatter, atol=1e-11 * abs(scatter).max())
    assert (np.diff(whole.d) >= 0).all()


def test_one_update_with_equal_and_empty_weights():
    d, q = np.array([0.0, 0.0, 1.0, 1.0, 1.0 + 1e-16, 4.0]), np.eye(6)
    for v in (np.array([1.0, 2, 0, 3, 1, 0]), np.zeros(6), np.array([0, 0, 0, 0, 0, 2.0]), np.full(6, 1e-200)):
        e, u = rank_one(d, q, v, 0.7)
        assert np.allclose(u * e @ u.T, np.diag(d) + 0.7 * np.outer(v, v), atol=1e-14) and np.allclose(u.T @ u, np.eye(6), atol=1e-14)


def test_query_equals_a_dense_decomposition(spark, sf, table):
    from provlake.llm import QUERIES

    compare(QUERIES["op12_whitening"](spark, sf).collect(), [(r.vec_id, r.embedding) for r in table("embeddings").collect()])


def test_edge_cases(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rnd.normal(size=5)]) for i in range(60)] + [(7, [0.5] * 5)] * 300
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (105, [1.0, 2.0])]
    kind = "vec_id long, embedding array<double>"
    docs = spark.createDataFrame(rows + odd, kind).repartition(40).withColumns({c: F.lit("clash") for c in ("x", "e", "n", "part", "component", "label")})
    whole = whitening.whole_vectors(docs)
    vectors = [(k, e) for k, (_, e) in enumerate(rows)]
    numbered = spark.createDataFrame(vectors, kind)
    compare(whitening.whitened(whitening.whole_vectors(numbered), whitening.fitted(whole)).collect(), vectors)
    assert whitening.whitened(whole, whitening.fitted(whole)).count() == len(rows) * 5
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, odd[:2]):
        some = whitening.whole_vectors(spark.createDataFrame(few, kind))
        assert whitening.whitened(some, whitening.fitted(some)).count() == 0
    flat = whitening.whole_vectors(spark.createDataFrame([(None, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0])], kind))
    got = sorted((str(r.vec_id), r.component, abs(r.whitened), r.deviation) for r in whitening.whitened(flat, whitening.fitted(flat)).collect())
    assert got == [("2", 1, 1.0, 128**2), ("None", 1, 1.0, 128**2)]


def test_deviations_are_exact_or_null():
    x = np.array([[2**40, 5], [-(2**40), 6], [3, 7]], dtype=np.int64)
    sums = [int(c) for c in x.sum(axis=0)]
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    assert whitening.deviations(x, 3, sums) == [w if w < 2**63 else None for w in want]
    n, total = 10**10, [10**16 + 1, 3]
    assert whitening.deviations(np.array([[1_000_000, 0]]), n, total) == [1 + 9]
