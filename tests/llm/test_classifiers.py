import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import hashed, quality, toxicity


def words(r, n):
    return [r.choice(["the", "of", "on"]) if r.random() < 0.4 else f"w{r.randrange(3000)}" for _ in range(n)]


def test_nnpu_from_positive_and_unlabelled_rows():
    r = random.Random(1)
    make = lambda bad: " ".join(words(r, 60) + ([r.choice(["zork", "blarg", "fnord"])] * 2 if bad else []))
    pos = [hashed.words_of(make(True)) for _ in range(200)]
    unl = [hashed.words_of(make(i % 10 == 0)) for i in range(1500)]
    model = toxicity.fit_rows(pos, unl, 0.1)
    texts = [make(i % 2 == 0) for i in range(400)]
    hit = model.scores(texts) >= 0.5
    assert (hit == (np.arange(400) % 2 == 0)).mean() > 0.98
    assert toxicity.fit_rows([], unl, 0.1).scores(["zork", None]).max() < 1e-9


def sparse(g, n, width=12):
    idx = [g.choice(width, size=g.integers(0, 6), replace=False) for _ in range(n)]
    return hashed.Rows(idx, [g.random(len(i)) for i in idx]), [{int(a): 0.0 for a in i} for i in idx]


def slope(f, x, j, e=1e-6):
    d = np.zeros(len(x))
    d[j] = e
    return (f(x + d) - f(x - d)) / (2 * e)


def test_corrected_risk_by_hand_and_by_differences():
    g = np.random.default_rng(0)
    p, u = sparse(g, 30)[0], sparse(g, 80)[0]
    for prior, b, scale in ((0.3, 0.2, 0.5), (0.45, -3.0, 3.0)):
        w = g.normal(size=12) * scale
        dense = lambda rows: np.array([[rows.val[(rows.row == i) & (rows.idx == j)].sum() for j in range(12)] for i in range(rows.n)])
        loss = lambda z, y: np.log1p(np.exp(-y * z)).mean()
        z_p, z_u = dense(p) @ w + b, dense(u) @ w + b
        whole, clean, by_w, by_b, toxic = toxicity.risk(p, u, w, b, prior)
        assert abs(toxic - prior * loss(z_p, 1)) < 1e-9 and abs(clean - (loss(z_u, -1) - prior * loss(z_p, -1))) < 1e-9
        assert abs(whole - (toxic + max(0, clean))) < 1e-12
        for j in range(12):
            assert abs(slope(lambda x: sum(toxicity.risk(p, u, x, b, prior)[i] for i in (1, 4)), w, j) - by_w[0][j]) < 1e-6
            assert abs(slope(lambda x: -toxicity.risk(p, u, x, b, prior)[1], w, j) - by_w[1][j]) < 1e-6
        assert abs(slope(lambda x: sum(toxicity.risk(p, u, w, x[0], prior)[i] for i in (1, 4)), np.array([b]), 0) - by_b[0]) < 1e-6
        assert abs(slope(lambda x: -toxicity.risk(p, u, w, x[0], prior)[1], np.array([b]), 0) - by_b[1]) < 1e-6


def test_ordinal_likelihood_by_hand_and_by_differences():
    g = np.random.default_rng(1)
    rows = sparse(g, 60)[0]
    k, w, p = g.integers(0, 4, 60), g.normal(size=12), np.array([-0.7, -0.2, 0.4])
    t = [-np.inf, *quality._ordered(p), np.inf]
    assert (np.diff(t[1:-1]) > 0).all()
    x = rows.dot(w)
    chance = [1 / (1 + np.exp(-(t[a + 1] - z))) - 1 / (1 + np.exp(-(t[a] - z))) for a, z in zip(k, x)]
    value, g_w, g_p = quality.likelihood(rows, k, w, p)
    assert abs(value + np.log(chance).mean()) < 1e-9
    for j in range(12):
        assert abs(slope(lambda v: quality.likelihood(rows, k, v, p)[0], w, j) - g_w[j]) < 1e-6
    for j in range(3):
        assert abs(slope(lambda v: quality.likelihood(rows, k, w, v)[0], p, j) - g_p[j]) < 1e-6


def test_a_repeated_id_teaches_once(spark):
    rows = [(i, f"good text number {i % 7}") for i in range(60)] + [(100 + i, f"zork text number {i % 7}") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, int("zork" in t)) for i, t in rows], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = spark.createDataFrame(rows + [(101, "good text number 3")] * 200 + rows[:5] * 50, "doc_id long, text string")
    a, b = (toxicity.train(d, labels) for d in (often.where("not (doc_id = 101 and text like 'good%')"), once))
    assert a.features.tolist() == b.features.tolist() and np.allclose(a.weights, b.weights)
    assert len(toxicity.train(often, labels).features) > 0
    g = labels.select("doc_id", F.col("toxic").alias("grade"))
    a, b = quality.train(once.unionByName(once), g), quality.train(once, g)
    assert np.allclose(a.thresholds, b.thresholds)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x y", 5, "a", 7.0)], "doc_id long, text string, grade int, idx string, expected_grade double")
    ratings = spark.createDataFrame([(2, 0), (3, 1)], "doc_id long, grade int")
    model = quality.train(docs, ratings)
    got = quality.rate(docs, model, 1).first()
    assert (got.grade, got.idx) == (5, "a") and 0 <= got.expected_grade <= 1


def test_ordinal():
    r = random.Random(2)

    def text(g):
        return " ".join(w if r.random() > (2 - g) * 0.4 else w.upper() + "!!" for w in words(r, 80))

    y = np.array([i % 3 for i in range(900)])
    feats = [hashed.style_of(text(g)) for g in y]
    model = quality.fit_rows(quality.Rows([f[0] for f in feats], [f[1] for f in feats]), y)
    assert (np.diff(model.thresholds) > 0).all()
    y2 = [i % 3 for i in range(300)]
    t = model.at_least([text(g) for g in y2])
    assert (np.diff(t, axis=1) <= 0).all() and np.abs(model.expected(t) - y2).mean() < 0.2
    assert (model.tail(t, 0) == 1).all() and (model.tail(t, 3) == 0).all() and (model.tail(t, 1) == t[:, 0]).all()
    one = quality.fit_rows(quality.Rows([np.array([1])]), np.array([4]))
    assert one.tail(one.at_least(["x"]), 4)[0] == 1 and one.expected(one.at_least(["x"]))[0] == 4


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_toxicity_held_out(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("doc_id", "text", "toxic", F.lit(1).alias("score")), model)
    rows = got.collect()
    assert all(zlib.crc32(str(x.doc_id).encode()) % 5 == 0 for x in rows)
    hit = [(x.score >= 0.5, x.toxic == 1) for x in rows]
    assert sum(a == b for a, b in hit) / len(hit) > 0.97
    assert sum(a and b for a, b in hit) / sum(b for _, b in hit) > 0.85


def test_quality_held_out(spark, tables):
    docs, labels = tables
    model = quality.train(docs, quality.grades(labels))
    rows = quality.rate(docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("text", "quality"), model, 1).collect()
    kept = [(x.tail_probability >= 0.5, x.quality == 1) for x in rows]
    assert sum(a for a, b in kept if b) / sum(b for _, b in kept) > 0.98
    assert sum(a for a, b in kept if not b) / sum(not b for _, b in kept) < 0.35


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x", 0), (1, None, 0), (3, "w " * 200000, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and all(x.score < 1e-9 for x in got)
    rated = quality.rate(docs, quality.train(docs, quality.grades(labels)), 0).collect()
    assert [x.tail_probability for x in rated] == [1.0] * 5
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count() == 0
    assert quality.rate(empty, quality.train(empty, quality.grades(labels.limit(0))), 1).count() == 0
