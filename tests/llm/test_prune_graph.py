import random

import numpy as np
import pytest

from provlake.llm import prune_graph as pg


def plain(rows, least=0.95):
    """Brute force: (vec_id, links, component) of every row."""
    unit = []
    for i, v in rows:
        ok = v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        u = np.array(v, dtype=float) / max(map(abs, v)) if ok else None  # scaled first: the squares of tiny numbers vanish
        unit.append(u / np.linalg.norm(u) if ok else None)
    good = [i for i, u in enumerate(unit) if u is not None]
    x = np.array([unit[i] for i in good])
    m = x @ x.T >= least
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in np.argwhere(m):
        if a < b:
            ra, rb = root(good[a]), root(good[b])
            parent[max(ra, rb)] = min(ra, rb)
    names = {}
    for i, (vid, _) in enumerate(rows):
        if vid is not None:
            names[root(i)] = min(names.get(root(i), vid), vid)
    n = dict(zip(good, m.sum(axis=1) - 1, strict=True))
    return sorted(((vid, int(n.get(i, 0)), names.get(root(i))) for i, (vid, _) in enumerate(rows)), key=str)


def vectors():
    rng, rnd = np.random.default_rng(5), random.Random(5)
    rows = []
    for _ in range(60):  # groups of near and exact copies among strangers
        c = rng.normal(size=16)
        rows += [c] + [c + rng.normal(size=16) * rnd.choice([0, 0.05, 0.1, 0.2]) for _ in range(rnd.randrange(8))]
    dense = rng.normal(size=16)
    rows += [dense + rng.normal(size=16) * 0.15 for _ in range(400)]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(rows)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3]
    return rows + [(n + i, v) for i, v in enumerate(odd)] + [(None, rows[0][1]), rows[1], (n + 20, [1e-200 * x for x in rows[2][1]])]


@pytest.mark.parametrize("shard_rows", [3000, 90])
def test_links_equal_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(pg, "CLUSTER_ROWS", 100)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    out, recall = pg.near_links(df, shard_rows=shard_rows)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in out.collect()), key=str)
    want = plain(rows)
    assert recall >= 0.98 and [g[0] for g in got] == [w[0] for w in want]
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g != w for g, w in zip(got, want, strict=True)) <= 0.02 * len(want)


def test_graph_search_finds_what_is_in_range():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    x[300:] = x[:300] + rng.normal(size=(300, 16)) * 0.1
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = pg.range_search(x, pg.graph(x), x, (0,), 0.95)
    true = x @ x.T >= 0.95
    assert not (hit & ~true).any() and hit.sum() >= 0.97 * true.sum()


def test_query_and_empty(spark, sf):
    rows = pg.op9_prune_graph(spark, sf).collect()
    assert len({r.vec_id for r in rows}) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in rows)
    out, _ = pg.near_links(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert out.count() == 0


def test_audit_is_not_carried_by_a_dense_group(spark, monkeypatch):
    """All links of a dense group found, none of the pairs: the audit says so, over all its queries in several passes."""
    monkeypatch.setattr(pg, "AUDIT_PASS", 40)
    rng = np.random.default_rng(3)
    dense, pairs = rng.normal(size=16), rng.normal(size=(100, 16))
    x = np.concatenate([dense + rng.normal(size=(200, 16)) * 0.01, pairs, pairs])
    x /= np.linalg.norm(x, axis=1)[:, None]
    valid = spark.createDataFrame([(i, 20 * i, v.tolist()) for i, v in enumerate(x)], "row long, vec_id long, v array<double>")
    m = (x @ x.T >= 0.95).sum(axis=1) - 1
    found = lambda rows: spark.createDataFrame([(i, int(m[i]), -1) for i in rows], pg.FOUND)
    assert pg.audit(valid, found(range(200)), 0.95) == pytest.approx(0.5)
    assert pg.audit(valid, found(range(400)), 0.95) == 1.0
    assert pg.audit(valid, found(range(200, 400)), 0.95) < 0.01
