import itertools
import random

from tokenizers import Tokenizer

from tracewright.llm import bpe, packing


def test_best_filling_is_best():
    r = random.Random(3)
    for _ in range(300):
        counts = {r.randrange(1, 20): r.randrange(1, 4) for _ in range(r.randrange(1, 5))}
        used = packing.best_filling(counts, 20)
        assert all(used[n] <= counts[n] for n in used) and max(counts) in used
        first = max(counts)
        sums = {first + sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*(range(c + 1 - (n == first)) for n, c in counts.items()))}
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= 20)


def test_fillings_use_all():
    r = random.Random(4)
    counts = {n: r.randrange(0, 9) for n in range(1, 300)}
    got = {}
    for used, times in packing.fillings(counts, 2048):
        assert sum(n * k for n, k in used.items()) <= 2048
        for n, k in used.items():
            got[n] = got.get(n, 0) + k * times
    assert got == {n: c for n, c in counts.items() if c}


def test_pack(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "of", "x9"]) for _ in range(r.randrange(0, 90))), "c") for i in range(300)]
    rows += [(1000, None, "c"), (1001, "", "c"), (7, rows[7][1], "c"), (None, "tail", "c"), (1002, "word " * 700, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    out = packing.pack(docs, window=64, pool=40).collect()
    tok, pieces, seqs = Tokenizer.from_file(bpe.vocabulary_path()), {}, {}
    for x in out:
        pieces.setdefault(x.doc_id, []).append(x)
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
        assert len(x.ids) == 4 * x.length
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    for d, t, _ in rows:
        mine = sorted(pieces[d], key=lambda x: x.start)[:: 2 if d == 7 else 1]
        assert b"".join(x.ids for x in mine) == b"".join(i.to_bytes(4, "little") for i in [*tok.encode(t or "", add_special_tokens=False).ids, 1])
    s = packing.slack(packing.pack(docs, window=64), 64).first()
    assert s.padding <= 64 and s.tokens == sum(x.length for x in out)
    assert packing.pack(docs.limit(0)).count() == 0


def test_repeats_of_a_length_that_fills_no_window(spark):
    """Equal texts, two of which fit in a window: dealt to several tasks, packed the same way on a rerun."""
    text = "word " * 39
    docs = spark.createDataFrame([(7, text)] * 500 + [(i, text) for i in range(1000, 1100)], "doc_id long, text string").repartition(3)
    out = packing.pack(docs, window=100, pool=64)
    rows = out.collect()
    assert len(rows) == 600 and len({x.sequence_id for x in rows}) <= 300 + 15
    assert len({x.sequence_id >> 36 for x in rows}) >= 8
    assert sorted(map(str, out.collect())) == sorted(map(str, rows))


def test_a_very_long_text(spark):
    text = "a few words, " * 100_000
    docs = spark.createDataFrame([(1, text), (1, text), (2, "short")], "doc_id long, text string")
    rows = packing.pack(docs).collect()
    n = len(Tokenizer.from_file(bpe.vocabulary_path()).encode(text, add_special_tokens=False).ids) + 1
    assert sum(x.length for x in rows if x.doc_id == 1) == 2 * n and {x.doc_tokens for x in rows if x.doc_id == 1} == {n}
