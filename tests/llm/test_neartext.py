import random

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import neartext


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {x.doc_id for x in neartext.deduplicate(df).collect()}


def least_of_groups(texts):
    """By all pairs."""
    w = [t.split() for t in texts]
    s = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in w]
    c = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if c[i] != c[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                a, b = min(c[i], c[j]), max(c[i], c[j])
                c = [a if k == b else k for k in c]
    return set(c)


def family(r, n, pairs):
    """Texts of one template, alike to less than 0.8 mostly, among them pairs of 0.8 and more that differ in the end."""
    template = [f"w{r.randrange(5000)}" for _ in range(200)]

    def changed(words, times):
        words = list(words)
        for i in r.sample(range(r.randrange(6), len(words), 6), times):
            words[i] = f"new{r.randrange(10**9)}"
        return words

    out = [changed(template, 5) for _ in range(n)]
    out += [w[:-19] + [f"end{r.randrange(10**9)}" for _ in range(19)] for w in out[:pairs]]
    r.shuffle(out)
    return [" ".join(w) for w in out]


def test_family_of_similar_texts(spark, monkeypatch):
    monkeypatch.setattr(neartext, "CHUNK", 60)
    texts = family(random.Random(5), 240, 60)
    want = least_of_groups(texts)
    assert 200 < len(want) < 290
    assert kept(spark, texts) == want


def test_appended_and_truncated(spark):
    r = random.Random(6)
    word = lambda: f"w{r.randrange(20000)}"
    texts = []
    for k in range(150):
        w = [word() for _ in range(r.choice([30, 100, 400]))]
        more = [word() for _ in range(int(len(w) * 0.22))]
        texts += [" ".join(w), " ".join([w + more, more + w, w[: int(len(w) * 0.85)]][k % 3])]
    want = least_of_groups(texts)
    assert want == set(range(0, 300, 2))
    assert kept(spark, texts) == want


def test_prefix_size():
    for n in range(1, 3000):
        least = next(k for k in range(int(0.8 * n) - 2, n + 1) if k / n >= 0.8)
        assert neartext.prefix_size(n, 0.8) == n - least + 1


def test_every_bucket_counts(spark, monkeypatch):
    """A link is found in whatever large bucket its texts meet, whether buckets are compared at once or one by one."""
    g = np.random.default_rng(2)
    sets = [np.unique(g.integers(0, 1 << 31, 60, dtype=np.uint32)) for _ in range(40)]
    for i in range(20, 40):
        sets[i] = np.unique(np.concatenate([sets[i - 20][:55], sets[i][:5]]))
    rows = [(key, 20, 1200, node, 60) for key, of in enumerate([range(20), range(10, 30), range(20, 40)]) for node in of]
    rows += [(100 + i, 20, 1200, node, 60) for i in range(4) for node in range(i, 40, 2)]
    keyed = spark.createDataFrame(rows, "key long, n long, shingles long, node long, size int")
    held = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "node long, h binary")
    want = {(i, i + 20) for i in range(20)}
    for chunk, whole in ((1024, True), (20, True), (12, False)):
        monkeypatch.setattr(neartext, "CHUNK", chunk)
        monkeypatch.setattr(neartext, "CHUNK_SHINGLES", 1 << 20 if chunk > 12 else 1200)
        many = neartext.blocks(keyed)
        got = {(min(x), max(x)) for x in neartext.block_links(many, held, 0.8).collect()}
        assert got == want, (chunk, got ^ want)


def test_small_families(spark):
    r = random.Random(8)
    texts = [t for _ in range(4) for t in family(r, 60, 25)]
    assert kept(spark, texts) == least_of_groups(texts)


def crowd(r, n, loose):
    """Near copies of one text, and some that are alike to a few of them only."""
    w = [f"w{r.randrange(5000)}" for _ in range(200)]
    out = []
    for i in range(n):
        v = list(w)
        for k in r.sample(range(200), 1):
            v[k] = f"new{r.randrange(10**9)}"
        out.append(v)
    for v in r.sample(out, loose):
        v = list(v)
        v[-17:] = [f"end{r.randrange(10**9)}" for _ in range(17)]
        out.append(v)
    r.shuffle(out)
    return [" ".join(v) for v in out]


def test_leaders_of_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(neartext, "CHUNK", 30)
    monkeypatch.setattr(neartext, "SHARE", 3)
    r = random.Random(12)
    texts = crowd(r, 150, 25) + family(r, 90, 30)
    want = least_of_groups(texts)
    assert len(want) < 140
    assert kept(spark, texts) == want


def test_alike_texts_are_compared_in_proportion(spark, monkeypatch):
    """Of a large group of near copies each is compared with the leaders, not with all others."""
    monkeypatch.setattr(neartext, "CHUNK", 30)
    g = np.random.default_rng(1)
    base = g.integers(0, 1 << 31, 200, dtype=np.uint32)
    sets = [np.unique(np.concatenate([base[5:], g.integers(0, 1 << 31, 5, dtype=np.uint32)])) for _ in range(300)]
    many = spark.createDataFrame([(True, 7, i, 10) for i in range(300)], "whole boolean, block long, node long, chunks int")
    held = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "node long, h binary")
    links = neartext.block_links(many, held, 0.8).collect()
    assert {(x.u, x.v) for x in links} == {(i, 0) for i in range(1, 300)}


def test_fingerprints_propose(spark):
    """Texts of one fingerprint and of close ones are proposed by the operator's blocks, far ones aren't."""
    rows = [(0, 5), (1, 5), (2, 5), (3, 5 ^ 3 << 40), (4, 5 ^ 7 << 20), (5, -5), (6, -5 ^ 1 << 62)]
    pairs = {tuple(x) for x in neartext.fingerprint_pairs(spark.createDataFrame(rows, "node long, fp long")).select("u", "v").collect()}
    assert pairs == {(0, 1), (0, 2), (0, 3), (5, 6)}


def test_links_by_fingerprints_are_verified(spark, monkeypatch):
    """Without the prefix filter only what fingerprints propose and shingles confirm is joined."""
    r = random.Random(8)
    words = [f"w{r.randrange(9000)}" for _ in range(4000)]
    texts = [" ".join(words), " ".join([*words, "more"]), "other words stand here alone for once", " ".join(words[:1700])]
    monkeypatch.setattr(neartext, "buckets", lambda texts, similarity: spark.createDataFrame([], "key long, n long, shingles long, node long, size int, at int").transform(lambda d: neartext.materialize(d, "none")))
    assert kept(spark, texts) == {0, 2, 3}


def test_counted_keys_are_made_once(spark):
    """The table of keys is written before it is read three times: its plan isn't repeated."""
    from tracewright.llm.common import join_counted

    rows = spark.range(100).withColumn("key", F.col("id") % 7)
    keys = rows.groupBy("key").agg(F.count("*").alias("n"))
    out = join_counted(rows, keys, "key", "n", 100, most=10)
    assert out.count() == 100 and "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
