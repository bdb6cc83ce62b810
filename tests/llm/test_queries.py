"""The registered queries, digests and all, over the smallest tables against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.test_pii import plain as plain_pii
from tests.llm.test_simhash import plain_fp
from tracewright.llm import bpe, queries

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"select doc_id, text from '{D}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def ids(docs):
    tok = Tokenizer.from_file(bpe.vocabulary_path())
    tok.no_truncation()
    tok.no_padding()
    return {d: tok.encode(t or "", add_special_tokens=False).ids for d, t in docs.items()}


def raw(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_op1(spark, ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for x in queries.op1_packing(spark, D).collect():
        pieces[x.doc_id].append(x)
        sequences[x.sequence_id].append((x.offset, x.length))
    for d, i in ids.items():
        at, whole = 0, [*i, 1]
        for p in sorted(pieces[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(whole) and p.ids_crc32 == zlib.crc32(raw(whole[at : at + p.length]))
            at += p.length
        assert at == len(whole)
    used = 0
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
        used += at
    assert used / (2048 * len(sequences)) > 0.98


def test_op3(spark, docs, ids):
    got = {x.doc_id: x for x in queries.op3_bpe(spark, D).collect()}
    for d, t in docs.items():
        assert got[d].n_tokens == len(ids[d]) and got[d].ids_sha256 == hashlib.sha256(raw(ids[d])).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_op4(spark, docs):
    rows = queries.op4_sharding(spark, D).collect()
    load, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for x in rows:
        t = (docs[x.doc_id] or "").encode()
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        load[x.shard] += x.size
        slots[x.shard].append(x.slot)
        homes[t].add(x.shard)
    assert len(rows) == len(docs) and all(len(h) == 1 for h in homes.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) < 1.15 * min(load.values())


def with_near_copies(spark, tmp_path):
    """The table's vectors, and near copies of every third; no two vectors of the table itself are alike to 0.9."""
    v = duckdb.sql(f"select vec_id, embedding from '{D}/embeddings.parquet' order by 1").fetchall()
    g = np.random.default_rng(1)
    top = max(i for i, _ in v) + 1
    v += [(top + k, (np.array(e) + g.normal(size=len(e)) * 0.03 * np.linalg.norm(e) / len(e) ** 0.5 * (1 + k % 20)).astype(np.float32).tolist()) for k, (_, e) in enumerate(v[::3])]
    spark.createDataFrame([(i, e, 0) for i, e in v], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return v, str(tmp_path)


def test_op5_and_op9(spark, tmp_path):
    v, d = with_near_copies(spark, tmp_path)
    x = np.array([e for _, e in v], dtype=np.float32).astype(float)
    c = x @ x.T / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1))) >= 0.9
    assert c.sum() > len(v) + 100
    comp = np.arange(len(v))
    while True:
        new = np.array([comp[c[i]].min() for i in range(len(v))])
        if (new == comp).all():
            break
        comp = new
    ids = [i for i, _ in v]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op5_rangejoin(spark, d).collect()}
    assert got == {ids[i]: (int(c[i].sum()) - 1, ids[comp[i]], comp[i] == i) for i in range(len(v))}
    found = defaultdict(list)
    for r in queries.op9_vptree(spark, d).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = n = 0
    for i, q in enumerate(ids):
        if q % 20 == 0:
            s = (x * x[i]).sum(axis=1)
            want = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != i)[:20]
            mine = sorted(found[q])
            assert [r for r, _, _ in mine] == list(range(1, 21)) and all(abs(s[ids.index(j)] - z) < 1e-12 for _, j, z in mine)
            hit += len({j for _, j, _ in mine} & {j for _, j in want})
            n += 20
    assert len(found) == sum(i % 20 == 0 for i in ids) and hit / n >= 0.9


def test_op6(spark, docs):
    for x in queries.op6_pii(spark, D).collect():
        base = plain_pii(docs[x.doc_id])
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert x.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(b[0] == k for b in base) for k in ("email", "ip", "card", "phone"))
        assert set(listed.split(",")) - {""} <= set(x.spans.split(","))


def test_op7_as_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{D}/pages.parquet'")
    want = c.sql(queries.oracle_sql()["op7_urls"]).fetchall()
    assert sorted(map(tuple, queries.op7_urls(spark, D).collect()), key=str) == sorted(want, key=str)


def test_op2_and_op8(spark, docs):
    for name in ("op2_toxicity", "op8_quality"):
        rows = queries.queries()[name](spark, D).collect()
        assert sorted(x.doc_id for x in rows) == sorted(docs) and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in rows)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in queries.op2_toxicity(spark, D).collect())


def test_op10(spark, docs):
    fps = {d: plain_fp(t) for d, t in docs.items()}
    comp = {d: d for d in docs}
    order = sorted(docs)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = comp[a], comp[b]
                comp = {d: min(x, y) if c in (x, y) else c for d, c in comp.items()}
    assert {x.doc_id: (x.fingerprint, x.component_id) for x in queries.op10_simhash(spark, D).collect()} == {d: (f"{fps[d]:016x}", comp[d]) for d in docs}
    assert all(re.fullmatch("[0-9a-f]{16}", x.fingerprint) for x in queries.op10_simhash(spark, D).collect())
