"""Near-duplicate documents: fingerprints and rare shingles propose, all shingles decide.

Two texts are linked if the Jaccard similarity of their sets of word shingles (five words) is at least 0.8. SimHash
fingerprints of these propose first: texts of one fingerprint, and of fingerprints that pigeonhole blocks find to differ in
at most two bits. The pairs that fingerprints can't promise come by an exact prefix filter, so that every pair of 0.8
meets: with all shingles in one order, rarest first, two sets that are alike share one of the first ``prefix_size`` of each. Texts with such a shingle in common are a bucket. The pairs of small buckets are
checked one by one; in large buckets all pairs are counted chunk by chunk, and what comes out is a spanning forest of
links that are verified, which joins what all links join. In blocks of many chunks, texts are compared with a few leaders first; those that are alike to one leader
are joined by it and aren't compared with each other. Nothing is capped or left to chance; the order is estimated on a
sample, on which only the time depends.

Defined results: null text counts as empty; texts without words are copies of each other; a text with fewer words than
a shingle is one shingle; repeated rows are copies; other columns are left as they are; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import simhash
from tracewright.llm.common import components, discard, give_back, join_counted, materialize, text_batches, tidied, tidy
from tracewright.llm.simhash import shingle_hashes

#: Buckets up to this size are joined as rows.
SMALL = 8
#: Texts and shingles of a larger bucket that are compared in one place; beyond, it is dealt out to pairs of chunks.
CHUNK = 512
CHUNK_SHINGLES = 1 << 19
#: Leaders of a block of several chunks that its texts are compared with first, one after another.
LEADERS = 3
#: One in so many texts tells how common shingles are; shingles that are named as common at most (16 bytes each).
SHARE, COMMON = 8, 1_000_000
#: Texts that are named to every executor at most (about 60 bytes each); more go by a shuffle.
BROADCAST_TEXTS = 500_000


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Each different shingle's hash, ascending."""
    return np.unique(shingle_hashes(text, words))


def prefix_size(n: int, similarity: float) -> int:
    """How many of a set's ``n`` shingles to look at: sets that are alike share at least so many of the n that one of
    these is among them, in whatever order."""
    least = math.ceil(similarity * n)
    least -= least > 0 and (least - 1) / n >= similarity
    least += least / n < similarity
    return min(n, n - least + 1)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share. Shingles of many sets are counted by matrix products, a block of
    columns at a time, the others by listing the pairs that share them."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), dtype=np.float32 if len(row) < 1 << 24 else np.float64)
    often = df > max(1, n // 32)
    number = np.cumsum(often) - 1
    of = often[col]
    r, c = row[of], number[col[of]]
    by = np.argsort(c, kind="stable")
    r, c = r[by], c[by]
    for s in range(0, int(often.sum()), 1024):
        a, b = np.searchsorted(c, (s, s + 1024))
        m = np.zeros((n, min(1024, int(often.sum()) - s)), dtype=out.dtype)
        m[r[a:b], c[a:b] - s] = 1
        out += m @ m.T
    for d in np.unique(df[~often & (df > 1)]):
        of = ((df == d) & ~often)[col]
        held = row[of][np.argsort(col[of], kind="stable")].reshape(-1, d)
        for s in range(0, len(held), step := max(1, (1 << 19) // (d * d))):
            h = held[s : s + step]
            out += np.bincount((h[:, :, None] * n + h[:, None, :]).ravel(), minlength=n * n).reshape(n, n)
    return out


def verified_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a spanning forest of the links between sets that are alike; all pairs are looked at."""
    size = np.array([len(s) for s in sets], dtype=np.float64)
    both = shared_counts(sets)
    free, p, q = np.ones(len(sets), dtype=bool), [], []
    for s in range(len(sets)):
        todo = [s] if free[s] else []
        free[s] = False
        while todo:
            k = todo.pop()
            near = np.flatnonzero(free & (both[k] / (size[k] + size - both[k]) >= similarity))
            free[near] = False
            p.append(np.full(len(near), k))
            q.append(near)
            todo += near.tolist()
    return np.concatenate(p), np.concatenate(q)


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """``u, v`` (u < v) out of ``node, fp``: each text with the first of its fingerprint, and the firsts of fingerprints that
    are linked by ``simhash.links``."""
    firsts = materialize(texts.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "fingerprints")
    same = join_counted(texts.select("fp", "node"), firsts, "fp", "n", texts.count()).where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    near = materialize(simhash.links(firsts.select("fp")), "near-fingerprints")
    near = near.join(firsts.select(F.col("fp").alias("src"), F.col("first").alias("a")), "src").join(firsts.select(F.col("fp").alias("dst"), F.col("first").alias("b")), "dst")
    out = materialize(same.unionByName(near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))).distinct(), "proposed")
    discard(firsts)
    return out


def buckets(texts: DataFrame, similarity: float) -> DataFrame:
    """``key, n, shingles, node, size, at`` out of ``node, size, prefix``: texts with a shingle of their prefixes in common,
    how many they are and how many shingles they have in all; ``at`` is its place in the prefix.

    A text is left out of a bucket where it is alike to no text for which this would be the first shingle they share: of
    ``size`` shingles ``at`` come before it, and of the other text's ``first`` at least."""
    keyed = texts.select("node", "size", F.posexplode("prefix").alias("at", "key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.sum("size").alias("shingles")).where("n > 1")
    able = (F.col("size") - F.col("at")) / (F.col("size") + F.col("first")) >= similarity
    return materialize(keyed.join(sizes, "key").where(able).drop("first"), "buckets")


def small_pairs(keyed: DataFrame, similarity: float) -> DataFrame:
    """``u, v`` (u < v): the pairs of small buckets, but for those that can't be alike if this is the first shingle they
    share: in the bucket of the one that is, a pair that is alike stays."""
    few = keyed.where(F.col("n") <= SMALL)
    most = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    near = most / (F.col("a.size") + F.col("b.size") - most) >= similarity
    met = few.alias("a").join(few.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & near)
    return met.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()


def blocks(keyed: DataFrame) -> DataFrame:
    """``whole, block, node, chunks``: texts to compare, each with all others of its block. Buckets of the same texts
    overlap, so what large buckets join is one block, unless its buckets one by one are fewer rows."""
    many = keyed.where(F.col("n") > SMALL)
    chunks = lambda n, shingles: F.ceil(F.greatest(n / CHUNK, shingles / CHUNK_SHINGLES)).cast("int")
    hubs = many.groupBy("key").agg(F.min("node").alias("hub"))
    joined = materialize(components(many.join(hubs, "key").select("node", "hub"), "node", "hub"), "joined")
    many = many.withColumn("chunks", chunks(F.col("n"), F.col("shingles"))).join(joined, "node")
    once = many.groupBy("root", "node").agg(F.any_value("size").alias("size"), F.sum("chunks").alias("rows"))
    once = once.groupBy("root").agg(F.sum("rows").alias("rows"), F.count("*").alias("n"), F.sum("size").alias("shingles"))
    once = materialize(once.withColumn("all", chunks(F.col("n"), F.col("shingles"))).withColumn("whole", F.col("n") * F.col("all") <= F.col("rows")), "roots")
    whole = joined.join(once.where("whole"), "root").select("whole", F.col("root").alias("block"), "node", F.col("all").alias("chunks"))
    apart = many.join(once.where("not whole").select("root", "whole"), "root").select("whole", F.col("key").alias("block"), "node", "chunks")
    out = materialize(whole.unionByName(apart), "blocks")
    discard(joined, once)
    return out


def alike(pairs: DataFrame, sets: DataFrame, similarity: float, total: int | None = None) -> DataFrame:
    """The rows of ``pairs`` (u, v, and what else) whose sets are alike. With ``total``, the number of pairs, v may be the
    same for a large share of them."""
    kept = pairs.columns
    held = pairs.join(sets.select(F.col("node").alias("u"), F.col("h").alias("a")), "u")
    if total is None:
        held = held.join(sets.select(F.col("node").alias("v"), F.col("h").alias("b")), "v")
    else:
        often = materialize(pairs.groupBy("v").agg(F.count("*").alias("n")), "often")
        held = join_counted(held, often.join(sets.select(F.col("node").alias("v"), F.col("h").alias("b")), "v"), "v", "n", total, most=100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column("a").to_pylist(), b.column("b").to_pylist()
            ok = [jaccard(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) >= similarity for x, y in zip(a, c, strict=True)]
            yield b.select(kept).filter(pa.array(ok, pa.bool_()))

    return held.select(*kept, "a", "b").mapInArrow(tidied(run), pairs.schema)


def block_links(many: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``u, v``: verified links of the texts of each block that join all that its links join. ``sets``: ``node, h``, 32 bits of
    each shingle's hash."""
    # One number for a block; if two blocks had the same, they would be compared as one.
    many = many.select(F.xxhash64("whole", "block").alias("block"), "node", "chunks")

    def compare(rows):
        import pandas as pd

        node = rows["node"].to_numpy()
        p, q = verified_links([np.frombuffer(h, "<u4") for h in rows["h"]], similarity)
        tidy()
        return pd.DataFrame({"u": node[p], "v": node[q]})

    one = many.where("chunks = 1").join(sets, "node").select("block", "h", "node").groupBy("block").applyInPandas(compare, "u long, v long")
    rest = materialize(many.where("chunks > 1"), "rest")
    if rest.isEmpty():
        return one
    links, led = [one], []
    for _ in range(LEADERS):
        first = materialize(rest.groupBy("block").agg(F.min("node").alias("leader"), F.count("*").alias("n")), "leaders")
        total = rest.count()
        asked = join_counted(rest, first, "block", "n", total).where("node <> leader")
        asked = materialize(asked.select(F.col("node").alias("u"), F.col("leader").alias("v"), "block"), "with-leader")
        found = materialize(alike(asked, sets, similarity, total), "led")
        links.append(found.select("u", "v"))
        led.append(found.select("block", F.col("v").alias("leader"), F.col("u").alias("node")).unionByName(first.select("block", "leader", F.col("leader").alias("node"))))
        led[-1] = materialize(led[-1], "led")
        left = materialize(rest.join(led[-1], ["block", "node"], "left_anti"), "rest")
        rest = left
        give_back(rest.sparkSession)
        if rest.isEmpty():
            break
    # The texts of the leader that has most are joined already: only the others are compared, with each other and these.
    every = led[0]
    for x in led[1:]:
        every = every.unionByName(x)
    most = every.groupBy("block", "leader").agg(F.count("*").alias("n")).groupBy("block").agg(F.max_by("leader", F.struct("n", "leader")).alias("best"), F.max("n").alias("n"))
    every = every.select("block", "node", "leader").unionByName(rest.select("block", "node", F.lit(None).cast("long").alias("leader")))
    every = join_counted(every, most, "block", "n", every.count()).select("block", "node", F.coalesce(F.col("leader") == F.col("best"), F.lit(False)).alias("core"))
    every = materialize(every, "core")
    part = lambda c: F.ceil(F.greatest(F.count(F.when(c, 1)) / CHUNK, F.sum(F.when(c, F.col("size")).otherwise(0)) / CHUNK_SHINGLES)).cast("int")
    parts = every.join(sets.select("node", (F.octet_length("h") / 4).alias("size")), "node").groupBy("block").agg(part(F.col("core")).alias("cores"), part(~F.col("core")).alias("others"), F.count("*").alias("n")).where("others > 0")
    every = join_counted(every, materialize(parts, "parts"), "block", "n", every.count())
    chunks = F.when(F.col("core"), F.col("cores")).otherwise(F.col("others"))
    every = every.withColumn("own", F.pmod(F.xxhash64("node"), chunks.cast("long")).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda i, j, core: F.struct(F.least(i, j).alias("i") if not core else i.alias("i"), (F.greatest(i, j) if not core else j).alias("j"), F.lit(core).alias("with_core"))
    own = F.col("own")
    # A pair of chunks has the pairs within each, too; a chunk by itself is compared only where nothing else is there.
    alone = F.filter(upto(F.col("others")), lambda x: (x != own) | (F.col("others") == 1) & (F.col("cores") == 0))
    to = F.when(F.col("core"), F.transform(upto(F.col("others")), lambda x: pair(x, own, True))).otherwise(
        F.concat(F.transform(alone, lambda x: pair(own, x, False)), F.transform(upto(F.col("cores")), lambda x: pair(own, x, True)))
    )
    dealt = every.join(sets, "node").select("block", "node", "h", F.explode(to).alias("t")).select("block", "node", "h", "t.*")
    links.append(dealt.groupBy("block", "i", "j", "with_core").applyInPandas(compare, "u long, v long"))
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, ascending, and how many have them."""
    some = rows.where(F.pmod(F.xxhash64("id", "digest"), F.lit(SHARE)) == 0)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), words).view(np.int64))], ["h"])

    often = some.select("text").mapInArrow(tidied(shingles), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    found = often.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    return h[by := np.argsort(h)], n[by]


def prefix(h: np.ndarray, common: np.ndarray, count: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's shingles, rarest first."""
    if not len(h):
        return h
    n = np.zeros(len(h), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        n = np.where(common[at] == h, count[at], 0)
    return h[np.lexsort((h, n))[: prefix_size(len(h), similarity)]]


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id, digest, n, component, kept`` for each (id, text) of ``docs``: how many rows it has, the least id of its
    group, and whether it is the row that stands for the group."""
    spark = docs.sparkSession
    give_back(spark)
    text_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    # Texts without words are alike: one digest for all.
    digest = F.substring(F.sha2(F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text")).otherwise(""), 256), 1, 32)
    rows = rows.withColumn("digest", digest)
    kind = rows.schema["id"].dataType.simpleString()
    common = spark.sparkContext.broadcast(common_shingles(rows, words))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sets = [], []
            for t in b.column("text"):
                h = shingle_hashes(t.as_py(), words)
                fps.append(simhash.fingerprint(h))
                sets.append(np.unique(h))
            fp = pa.array(np.array(fps, dtype=np.uint64).view(np.int64), pa.int64())
            size = pa.array([len(h) for h in sets], pa.int32())
            first = pa.array([prefix(h, *common.value, similarity).view(np.int64) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("digest"), fp, size, first], ["id", "digest", "fp", "size", "prefix"])

    found = materialize(rows.mapInArrow(tidied(prefixes), f"id {kind}, digest string, fp long, size int, prefix array<long>"), "prefixes")
    counted = materialize(found.groupBy("id", "digest").agg(F.count("*").alias("n")), "counted")
    texts = found.groupBy("digest").agg(F.min("id").alias("id"), F.any_value("fp").alias("fp"), F.any_value("size").alias("size"), F.any_value("prefix").alias("prefix"))
    # Numbers are given once and written; what follows reads them from there.
    texts = materialize(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    discard(found)
    common.destroy()
    give_back(spark)
    proposed = fingerprint_pairs(texts)
    give_back(spark)
    keyed = buckets(texts, similarity)
    pairs = materialize(small_pairs(keyed, similarity).join(proposed, ["u", "v"], "left_anti"), "pairs")
    give_back(spark)
    many = blocks(keyed)
    discard(keyed)
    give_back(spark)

    asked = pairs.unionByName(proposed).select(F.explode(F.array("u", "v")).alias("node")).unionByName(many.select("node")).distinct().join(texts.select("node", "id", "digest"), "node")
    asked = materialize(asked.withColumnRenamed("id", "first"), "asked")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [np.unique(shingle_set(t.as_py(), words).astype("<u4")).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(h, pa.binary())], ["node", "h"])

    sets = rows.join(_small(asked), "digest").where(F.col("id").eqNullSafe(F.col("first")))
    sets = sets.select("node", "text").mapInArrow(tidied(shingles), "node long, h binary")
    sets = materialize(sets.groupBy("node").agg(F.any_value("h").alias("h")), "shingles")
    give_back(spark)
    links = materialize(alike(proposed.select(F.col("v").alias("u"), F.col("u").alias("v")), sets, similarity, proposed.count()), "by-fingerprint")
    links = links.unionByName(materialize(alike(pairs, sets, similarity), "by-prefix"))
    give_back(spark)
    links = materialize(links.unionByName(block_links(many, sets, similarity)), "near")
    discard(proposed, pairs, many, asked, sets)
    give_back(spark)

    roots = materialize(components(links, "u", "v"), "roots")
    give_back(spark)
    named = texts.select("node", "digest", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = F.min_by(F.struct("id", "digest"), F.struct(F.col("id").isNull(), "id", "digest")).alias("least")
    linked = materialize(named.join(roots.select("node"), "node", "left_semi"), "linked")
    least = linked.groupBy("root").agg(least, F.count("*").alias("n"))
    linked = join_counted(linked, least, "root", "n", linked.count()).select("digest", "least")
    alone = named.join(roots.select("node"), "node", "left_anti").select("digest", F.struct("id", "digest").alias("least"))
    named = materialize(linked.unionByName(alone), "named")
    discard(texts, links)
    give_back(spark)
    copies = counted.groupBy("digest").agg(F.count("*").alias("ids"))
    out = join_counted(counted, named.join(copies, "digest"), "digest", "ids", counted.count())
    kept = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("digest") == F.col("least.digest"))
    return out.select("id", "digest", "n", F.col("least.id").alias("component"), kept.alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each group, that of the least id, unchanged."""
    found = materialize(groups(docs, id_col, text_col, words, similarity).select("id", "digest", "n", "kept"), "groups")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("__key", F.substring(F.sha2(F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(""), 256), 1, 32))

    def of(k: DataFrame, how: str) -> DataFrame:
        k = _small(k.select(F.col("id").alias("__id"), F.col("digest").alias("__digest")))
        return keyed.join(k, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__digest")), how)

    once = of(found.where("not kept or n > 1"), "left_anti").drop("__key")
    # Repeated rows of one id and text: any one of them.
    again = found.where("kept and n > 1")
    return once if again.isEmpty() else once.unionByName(of(again, "left_semi").dropDuplicates([id_col, "__key"]).drop("__key"))


def _small(table: DataFrame) -> DataFrame:
    """A written table of names, broadcast if there are few enough."""
    return F.broadcast(table) if table.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS else table
