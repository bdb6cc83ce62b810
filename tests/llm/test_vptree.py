import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import vptree


def table(spark, n=600):
    g = np.random.default_rng(5)
    rows = [(i, [float(x) for x in (g.normal(size=6) * (1 + i % 3)).astype(np.float32)], "s") for i in range(n)]
    rows += [(1000 + i, rows[40][1], "s") for i in range(60)] + [(2000, None, "s"), (2020, [0.0] * 6, "s"), (2040, [1.0, None], "s"), (2060, [float("nan")], "s"), (2080, [3.0, 1.0], "s"), (None, rows[1][1], "s")]
    rows += [(20, rows[20][1], "s")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, ids string").repartition(3)


def brute(rows, k):
    good = [(i, np.array([*v, *[0] * (6 - len(v))], dtype=np.float32).astype(float)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in sorted({i: v for i, v in reversed(good)}.items()):
        if q % 20 == 0:
            near = sorted((-float((x * y).sum()), i) for i, y in good if i != q)[:k]
            out += [(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(near)]
    return out


@pytest.mark.parametrize("k,shard,block", [(20, 100, 9), (5, 10**6, 10**6), (10**4, 300, 50)])
def test_exact(spark, monkeypatch, k, shard, block):
    rows, df = table(spark)
    got = vptree.nearest(df, F.col("vec_id") % 20 == 0, k=k, shard=shard, block=block).collect()
    assert sorted((x.query_id, x.rank, x.vec_id, round(x.score, 9)) for x in got) == brute(rows, k)


def test_empty(spark):
    _, df = table(spark, 60)
    assert vptree.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert vptree.nearest(df, F.lit(False)).count() == 0


def clusters(n=4000, centres=40, dims=64):
    g = np.random.default_rng(2)
    c = g.normal(size=(centres, dims))
    x = c[g.integers(0, centres, n)] + g.normal(size=(n, dims)) * 0.3
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_tree_prunes_and_factor_one_is_exact():
    x = clusters()
    q = x[:100]
    want = np.argsort(-(q @ x.T), axis=1)[:, :10]
    for factor, least in ((1.0, 1.0), (1.1, 0.9)):
        tree = vptree.Tree(x, np.zeros(4000))
        _, pos = tree.search(q, 10, 1.0, factor)
        assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(pos, want)]) >= least
        assert tree.scored < 0.3 * 100 * 4000


def test_queries_look_into_few_shards():
    x = vptree.augmented(clusters(), 1.0)
    centres = vptree.spread(x, 60, 0.0)
    d = vptree.distances(x, centres)
    home = d.argmin(axis=1)
    radius = np.array([d[home == c, c].max() for c in range(len(centres))])
    q = x[:200, :-1]
    known = np.sort(q @ x[:, :-1].T, axis=1)[:, -21]
    visits = vptree.may_hold(q, centres, radius, 1.0, known, 1.0)
    in_shard = np.bincount(home, minlength=len(centres))
    assert (visits @ in_shard).mean() < 0.3 * len(x)
    best = np.argsort(-(q @ x[:, :-1].T), axis=1)[:, :20]
    assert all(visits[i, home[j]] for i in range(200) for j in best[i])


def test_recall_on_clusters(spark):
    x = clusters(1500).astype(np.float32)
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, factor=1.1, shard=100, block=30).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -9)
    want = {i: set(np.argsort(-s[i])[:20].tolist()) for i in range(0, 1500, 20)}
    assert np.mean([len(got[i] & want[i]) / 20 for i in want]) >= 0.9
