import math

import numpy as np
import pytest

from tracewright.llm import rangejoin


def brute(rows, c=0.9):
    def fine(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    w = max([len(v) for _, v, _ in rows if v is not None], default=1)
    x = [np.array([*v, *[0] * (w - len(v))], dtype=np.float32).astype(float) if fine(v) else None for _, v, _ in rows]
    comp, n = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if x[i] is not None and x[j] is not None and x[i] @ x[j] / math.sqrt(x[i] @ x[i]) / math.sqrt(x[j] @ x[j]) >= c:
                n[i] += 1
                n[j] += 1
                a, b = comp[i], comp[j]
                comp = [b if k == a else k for k in comp]
    least = {k: min(rows[i][0] for i in range(len(rows)) if comp[i] == k) for k in comp}
    return sorted((rows[i][0], n[i], least[comp[i]], rows[i][0] == least[comp[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("pivots,cell", [((1, 1), 1), ((2, 7), 10), ((8, 4096), 16)])
def test_against_brute_force(spark, monkeypatch, pivots, cell):
    monkeypatch.setattr(rangejoin, "CHUNK", 20)
    monkeypatch.setattr(rangejoin, "BLOCK", 8)
    monkeypatch.setattr(rangejoin, "PIVOTS", pivots)
    monkeypatch.setattr(rangejoin, "CELL", cell)
    g = np.random.default_rng(3)
    centres = g.normal(size=(12, 8))
    rows = [(i, [float(x) for x in (centres[i % 12] + g.normal(size=8) * 0.25 * (i % 4)).astype(np.float32)], 0) for i in range(260)]
    rows += [(400 + i, rows[3][1], 0) for i in range(30)] + [(500, None, 0), (501, [0.0] * 8, 0), (502, [1.0, None], 0), (503, [float("nan")] * 8, 0), (504, [], 0)]
    rows += [(505, [float("inf")] * 8, 0), (506, rows[9][1][:5], 0), (7, rows[7][1], 0), (507, [-0.0, 1.0], 0), (508, [0.0, 2.0, 0.0], 0), (500, rows[1][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int").repartition(3)
    assert sorted(tuple(x) for x in rangejoin.link(df).collect()) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in rangejoin.link(df).collect()] == [(1, 0, 1, True)]
    assert rangejoin.link(df.limit(0)).count() == 0


def test_clusters_are_compared_within(spark, monkeypatch):
    """Near copies around 40 centres: few pairs are compared, and no link is lost."""
    monkeypatch.setattr(rangejoin, "CELL", 32)
    g = np.random.default_rng(4)
    centres = g.normal(size=(40, 64))
    x = (centres[np.arange(1600) % 40] + g.normal(size=(1600, 64)) * 0.3).astype(np.float32)
    x[1500:] = (x[:100] + g.normal(size=(100, 64)) * 0.05).astype(np.float32)
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    _, _, found = rangejoin.join_cells(df, "vec_id", "embedding", 0.9)
    assert found.where("src is null").agg({"n": "sum"}).first()[0] < 0.3 * 1600 * 1599 / 2
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    c = u @ u.T >= 0.9
    comp = np.arange(1600)
    for _ in range(60):
        comp = np.array([comp[c[i]].min() for i in range(1600)])
    got = {r.vec_id: (r.n_links, r.component_id) for r in rangejoin.link(df).collect()}
    assert got == {i: (int(c[i].sum()) - 1, comp[i]) for i in range(1600)}
    assert sum(n > 0 for n, _ in got.values()) > 1500


def test_pivots_are_far_apart():
    g = np.random.default_rng(6)
    x = rangejoin.unit(np.repeat(g.normal(size=(30, 16)), 50, axis=0) + g.normal(size=(1500, 16)) * 0.05)
    p = rangejoin.choose_pivots(x, 10**6, 0.447)
    noise = rangejoin.unit(g.normal(size=(3000, 64)))
    assert len(rangejoin.choose_pivots(noise, 10**6, 0.447)) == rangejoin.PIVOTS[0]
    assert len(p) == 30 and (np.linalg.norm(p[:, None] - p[None], axis=2) + np.eye(30) > 0.447).all()
