import random
import re

import numpy as np
import xxhash

from tracewright.llm import simhash
from tracewright.llm.common import components


def plain_fp(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, None)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(root)}


def brute(rows, near):
    fps = [simhash.fingerprint(simhash.shingle_hashes(t, 3)) for _, t, _ in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= near:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    return [(rows[i][0], f"{fps[i]:016x}", least[comp[i]]) for i in range(len(rows))]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    monkeypatch.setattr(simhash, "SMALL", 3)
    r = random.Random(7)
    base = ["Ab", "the", "of", "x", "é", "to", "IN"]
    rows = []
    for i in range(150):
        w = [r.choice(base) + str(r.randrange(40)) for _ in range(r.randrange(1, 60))]
        rows.append((i, " ".join(w), "f"))
        if i % 5 == 0:
            for k in range(6):
                w[r.randrange(len(w))] = "new"
                rows.append((1000 + 10 * i + k, "\n".join(w), "f"))
    rows += [(900, "", "f"), (901, None, "f"), (902, " \t", "f"), (3, rows[3][1], "f"), (None, "alone", "f"), (903, "one two", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(4)
    for near, blocks in ((2, 4), (6, 8)):
        got = [(x.doc_id, f"{x.fp & (2**64 - 1):016x}", x.component_id) for x in simhash.near_duplicates(docs, max_distance=near, blocks=blocks).collect()]
        assert sorted(got, key=str) == sorted(brute(rows, near), key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_fingerprint():
    for t in ("", "a", "A b", "a b c d e f g", "Ä ö\x0bz \x85q", "w " * 500):
        assert simhash.fingerprint(simhash.shingle_hashes(t, 3)) == plain_fp(t)
    assert simhash.spanning(np.array([[1], [3]], dtype="u8"), np.array([[1], [3], [255]], dtype="u8"), 1) == ([0], [1])
