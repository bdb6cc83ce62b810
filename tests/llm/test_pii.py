import random
import re

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import pii

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def texts():
    r = random.Random(11)
    out = [None, "", "no data", "a@b.c", "é😀 x@y.zz and +1 (988) 555-2485 or 10.0.0.256 1.2.3.4.5.6.7.8", "a@b.com_x@y.org", "x@y@z.w", "a@b..c", "4111 1111-1111 1111", "4111  1111 1111 1111"]
    out += ["4111111111111111" + "0" * 40, "9" * 5000, "1 " * 5000, "a" * 5000 + "@b.c", "a@" + "b." * 5000 + "c", "1.1." * 3000, "+" + "1 " * 3000, "+1" * 2000, "000000001.02.3.0255"]
    pieces = ["a", "b1", "@", ".", "-", " ", "+", "1", "23", "4111111111111111", "(", ")", "255", "256", "_", "%", "😀", "é", "\n", "5500005555555559", "x@y.de", "+44 20 7946 0958"]
    out += ["".join(r.choice(pieces) for _ in range(r.randrange(1, 60))) for _ in range(1500)]
    return out


def test_base_against_brute_force(spark):
    rows = [(i, t, "k") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string").repartition(3)
    df = df.withColumns({c: F.lit("mine") for c in ("spans", "proposed", "_text", "_number", "kind")})
    got = {x.doc_id: x for x in pii.find(df).collect()}
    assert len(got) == len(rows) and all((x["_text"], x["_number"], x["kind"]) == ("mine",) * 3 for x in got.values())
    for i, t, _ in rows:
        base = [tuple(s) for s in got[i].base]
        assert base == plain(t), (i, t)
        assert set(base) <= {tuple(s) for s in got[i].spans}


def test_added_and_masked(spark):
    good = [f"call me on ({200 + i}) 555-{1000 + i} today" for i in range(60)]
    bad = [f"version {i}.20.31.{i} of order 2023-04-{10 + i % 20} {1000000 + i}" for i in range(60)]
    base = [f"phone +1 (555) 555-{1000 + i} and mail q{i}@mail.example.com" for i in range(60)]
    rows = [(i, t) for i, t in enumerate([*good, *bad, *base, "write to jo [at] mail.example.com", None])]
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("clean", pii.masked()).collect()
    by = {x.doc_id: x for x in out}
    assert all(by[i].clean == "call me on [PHONE] today" for i in range(60))
    assert all(not [s for s in by[i].spans if s.kind == "phone"] for i in range(60, 120))
    assert by[120].clean == "phone [PHONE] and mail [EMAIL]" and by[181].clean is None
    assert by[180].clean == "write to [EMAIL]"


def test_reliabilities():
    r = np.random.default_rng(1)
    truth = r.random(4000) < 0.3
    good, weak = np.where(r.random(4000) < 0.95, truth, ~truth), np.where(r.random(4000) < 0.6, truth, ~truth)
    other = np.where(r.random(4000) < 0.9, truth, ~truth)
    votes = np.column_stack([good, weak, other]) * 2 - 1
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = pii.reliabilities(patterns.astype(float), counts.astype(float), np.zeros(len(patterns), bool))
    assert ((p[inverse.ravel()] > 0.5) == truth).mean() > 0.94


def test_empty(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert pii.find(df.limit(0)).count() == 0
    one = pii.find(df).select("*", pii.listed("spans").alias("s"), F.size("base").alias("n")).first()
    assert one.s == "" and one.n == 0


def test_context_reaches_over_earlier_numbers(spark):
    rows = [(i, f"call ({300 + i}) 555-{1000 + i}, ({300 + i}) 555-{2000 + i} or 4{i:02d} 13 {i:02d} 99") for i in range(40)]
    found = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.explode("proposed").alias("x")).select("doc_id", "x.*")
    votes = {}
    for x in found.where("kind = 'phone'").collect():
        votes.setdefault(x.doc_id, []).append(x.context)
    assert all(v == [1, 1, 1] for v in votes.values()) and len(votes) == 40


def plain_proposals(text):
    """Spans of the wider patterns that touch no base span, by plain Python."""
    base = plain(text)
    out = []
    for m in re.finditer(pii.NUMBER, text):
        d = re.sub("[^0-9]", "", m[0])
        kind = "card" if 13 <= len(d) <= 19 and luhn(d) else "phone" if 7 <= len(d) <= 12 else None
        if kind and not any(s < m.end() and m.start() < e for _, s, e in base):
            out.append((kind, m.start(), m.end()))
    out += [("email", m.start(), m.end()) for m in re.finditer(pii.SPELT, text) if not any(s < m.end() and m.start() < e for _, s, e in base)]
    return sorted(out)


def test_added_spans_against_brute_force(spark):
    """What is added is what the weights decide on the proposals found by plain Python."""
    r = random.Random(5)
    some = ["call (415) 555-0134", "card 4111-1111-1111-1111 7", "jo [at] mail.example.org", "order 20 30 40 50", "2023-04-11 1234567", "(030) 1234 567", "fax 030-123-4567", "version 1.20.31.4455", "a@b.de", "+1 (555) 555-1000", "x", "é"]
    rows = [(i, t) for i, t in enumerate(texts())] + [(10_000 + i, " ".join(r.choice(some) for _ in range(r.randrange(1, 9)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = pii.candidates(docs)
    model = pii.train(found)
    proposed = {x.doc_id: [p for p in x.proposed if not p.base] for x in found.collect()}
    out = {x.doc_id: x for x in pii.decide(found, model).collect()}
    assert sum(map(len, proposed.values())) > 200
    for x in docs.collect():
        mine = proposed[x.doc_id]
        assert sorted((p.kind, p.start, p.end) for p in mine) == plain_proposals(x.text or "")
        votes = np.array([[p[v] for v in pii.LABELERS] for p in mine], dtype=float).reshape(len(mine), len(pii.LABELERS))
        f = pii._features(votes, np.array([p.digits for p in mine]), np.array([p.groups for p in mine]))
        want = {(p.kind, p.start, p.end) for p, row in zip(mine, f) if row @ np.array(model.weights[p.kind]) >= 0}
        assert {tuple(s) for s in out[x.doc_id].spans} - {tuple(s) for s in out[x.doc_id].base} == want
