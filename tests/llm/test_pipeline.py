import random

import pytest

import corpus_pipeline
from tracewright.llm import neartext

D = "/root/testdata/sf0.01"


def sets(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_copies_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for i in range(60):
        w = [f"w{r.randrange(5000)}" if r.random() < 0.6 else r.choice(["the", "of", "and"]) for _ in range(r.randrange(80, 300))]
        rows.append((10 * i, " ".join(w), "d", 1))
        for k in range(r.randrange(0, 4)):
            v = list(w)
            for _ in range(r.choice([0, 1, 1, 2])):
                v[r.randrange(len(v))] = "changed"
            rows.append((10 * i + k + 1, " ".join(v), "d", 1))
    rows += [(2000, None, "d", 1), (2001, "", "d", 1), (2002, " \n", "d", 1), (2003, "one two", "d", 1), (2004, "One  two", "d", 1), (0, rows[0][1], "d", 1), (2005, "two one", "d", 1), (None, "lonely text here", "d", 1)]
    s = [sets(t) for _, t, _, _ in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if not s[i] and not s[j] or s[i] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    want = {min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, n int").repartition(3)
    got = [x.doc_id for x in neartext.deduplicate(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert neartext.deduplicate(docs.limit(0)).count() == 0


def test_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neartext, "CHUNK", 30)
    r = random.Random(9)
    w = [f"w{r.randrange(4000)}" for _ in range(150)]
    rows = []
    for i in range(150):
        v = list(w)
        v[r.randrange(150)] = f"new{i}"
        rows.append((i, " ".join(v)))
    rows += [(1000 + i, " ".join(f"x{r.randrange(4000)}" for _ in range(90))) for i in range(40)]
    got = {x.doc_id for x in neartext.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {0, *range(1000, 1040)}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{D}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        f(spark, docs, D).write.parquet(path)
        out.append(docs := spark.read.parquet(path))
    return out


def test_stages(spark, stages):
    first = spark.read.parquet(f"{D}/documents.parquet")
    for df in stages[:4]:
        assert df.columns == first.columns
    texts = [{x.doc_id: x.text for x in df.collect()} for df in [first, *stages[:4]]]
    for before, after in zip(texts[:3], texts[1:4]):
        assert set(after) <= set(before) and all(before[i] == t for i, t in after.items())
        assert len(after) > 0.75 * len(before)
    assert set(texts[3]) == set(texts[4])
    left = [sets(t) for t in texts[3].values()]
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(left) for b in left[:i])
    gone = set(texts[2]) - set(texts[3])
    s = {i: sets(t) for i, t in texts[2].items()}
    assert all(any(j != i and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) for j in s) for i in gone)
    assert not any("@" in t and ".example.com" in t for t in texts[4].values())


def test_pieces_cover_the_documents(spark, stages):
    pieces = stages[4].collect()
    per = {}
    for p in pieces:
        per.setdefault(p.doc_id, []).append(p)
    assert set(per) == {x.doc_id for x in stages[3].select("doc_id").collect()}
    assert all(sum(p.length for p in ps) == ps[0].doc_tokens for ps in per.values())


ODD = "doc_id long, text string, score double, row string, spans string, digest string, n int, n_chars int, expected_grade int, _key int"


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls everywhere, empty and very long texts, repeats, and columns named as those that operators make."""
    long = " ".join(f"plain words of number {i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (2, ""), (None, "write to jo@mail.example.com today"), (None, None), (3, long), (3, long), (4, long + " end"), (5, "short text here"), (6, "other short text"), (5, "short text here")]
    docs = spark.createDataFrame([(i, t, None, "r", "s", "d", 1, 7, None, 3) for i, t in rows], ODD)
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (5, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for name, table in (("some", labels), ("none", labels.limit(0))):
        d = f"{tmp_path}/{name}"
        table.write.parquet(f"{d}/labels.parquet")
        left = docs
        for stage, f in corpus_pipeline.STAGES[:4]:
            before, left = left, f(spark, left, d)
            assert left.columns == docs.columns and left.dtypes == docs.dtypes
            assert f(spark, before.limit(0), d).count() == 0
            out = left.collect()
            assert {(x.row, x.spans, x.digest, x.n, x["_key"], x.score) for x in out} <= {("r", "s", "d", 1, 3, None)}
            if stage == "toxicity":
                assert len(out) == len(rows)
            if stage == "near_dedup":
                texts = [(x.doc_id, x.text) for x in out]
                assert len(set(texts)) == len(texts) and (3, long) in texts and (4, long + " end") not in texts and sum(not t for _, t in texts) == 1
        by = {x.doc_id: x for x in left.collect()}
        assert by[None].text == "write to [EMAIL] today" and by[None].n_chars == 22 and by[3].n_chars == 7
        pieces = corpus_pipeline.pack_sequences(spark, left, d).collect()
        assert {x.doc_id for x in pieces} == set(by) and corpus_pipeline.pack_sequences(spark, left.limit(0), d).count() == 0


def test_run(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in out.collect()} <= {x.doc_id for x in docs.collect()} and out.count() > 0
