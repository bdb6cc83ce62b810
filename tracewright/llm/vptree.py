"""Nearest neighbours by largest inner product: vantage-point trees per shard.

One more component turns inner products into a metric: with M the largest norm, (x, sqrt(M^2 - |x|^2)) and (q, 0) lie at
squared distance |q|^2 + M^2 - 2 q.x. Each shard is the ball around a centre and has a tree, built once. A query looks in
its nearest shard first; then in those whose ball may hold something nearer than the k-th found. A shard or a branch is
left out if the triangle inequality, its bound multiplied by ``factor``, puts all of it farther than that. Factor 1 is
exact search; larger factors leave out more.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id; of vectors of different lengths the shorter counts as filled up with zeros; equal scores go to the
smaller id; an id that occurs with several vectors is a candidate with each, and as a query has the first of them;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import materialize
from tracewright.llm.vectors import distances, matrix, raw_vectors, spread

#: Vectors of a shard and queries of a block, about: what a task holds. Centres at most, and the sample they come from.
SHARD = 4096
BLOCK = 8192
CENTRES, SAMPLE = 4096, 16_384
LEAF = 128


class Tree:
    """Vantage-point tree on augmented vectors. Inner nodes hold a point and, for the nearer and the farther part of the
    others, the least and the largest distance from it. Parts are cut at a gap between distances where there is a wide
    one, else in the middle. ``scored`` counts the inner products taken."""

    def __init__(self, x: np.ndarray, extra: np.ndarray, leaf: int = LEAF):
        self.x, self.extra, self.leaf, self.scored = x, extra, leaf, 0
        self.root = self._build(np.arange(len(x)))

    def _distance(self, idx: np.ndarray, vp: int) -> np.ndarray:
        d = self.x[idx] - self.x[vp]
        return np.sqrt(np.einsum("ij,ij->i", d, d) + (self.extra[idx] - self.extra[vp]) ** 2)

    def _build(self, idx: np.ndarray):
        if len(idx) <= self.leaf:
            return idx
        least, best = max(1, self.leaf // 4), None
        # Of some points the one with the widest gap, else one that is far from others: that makes shells thin.
        for vp in {int(idx[0]), int(idx[len(idx) // 2]), int(idx[self._distance(idx, idx[0]).argmax()])}:
            rest = idx[idx != vp]
            d = self._distance(rest, vp)
            rest, d = rest[order := np.argsort(d, kind="stable")], d[order]
            gaps = np.diff(d)[least - 1 : len(d) - least]
            at = least + int(gaps.argmax()) if len(gaps) else len(d) // 2
            wide = float(gaps.max()) / max(float(d[-1]), 1e-300) if len(gaps) else 0.0
            if best is None or (wide, vp) > best[0]:
                best = (wide, vp), rest, d, at if wide > 0.1 else len(d) // 2
        (_, vp), rest, d, at = best
        return vp, [(d[p].min(), d[p].max(), self._build(rest[p])) for p in (slice(0, at), slice(at, None))]

    def search(self, q: np.ndarray, k: int, largest: float, factor: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and positions of the k best of each query, best first; missing ones are -inf, -1. ``known``: a score
        of which k are known to be at least elsewhere; those below it may be missing."""
        best = np.full((len(q), k), -np.inf)
        known = np.full(len(q), -1e300) if known is None else np.maximum(known, -1e300)
        pos = np.full((len(q), k), -1, dtype=np.int64)
        base = np.einsum("ij,ij->i", q, q) + largest**2

        def take(active: np.ndarray, idx: np.ndarray) -> None:
            self.scored += len(active) * len(idx)
            s = q[active] @ self.x[idx].T
            if len(idx) > k:
                part = np.argpartition(-s, k - 1, axis=1)[:, :k]
                s, idx = np.take_along_axis(s, part, 1), idx[part]
            else:
                idx = np.broadcast_to(idx, s.shape)
            s, p = np.concatenate([best[active], s], axis=1), np.concatenate([pos[active], idx], axis=1)
            order = np.argsort(-s, axis=1, kind="stable")[:, :k]
            best[active], pos[active] = np.take_along_axis(s, order, 1), np.take_along_axis(p, order, 1)

        def visit(node, active: np.ndarray) -> None:
            if not len(active):
                return
            if isinstance(node, np.ndarray):
                if len(node):
                    take(active, node)
                return
            vp, halves = node
            take(active, np.array([vp]))
            d = np.sqrt(np.maximum(0.0, base[active] - 2.0 * (q[active] @ self.x[vp])))
            middle = (halves[0][1] + halves[1][0]) / 2
            inner = d <= middle

            def reach(half, who: np.ndarray) -> np.ndarray:
                lo, hi, _ = half
                bound = np.maximum(np.maximum(lo - d[who], d[who] - hi), 0.0) * factor
                found = np.sqrt(np.maximum(0.0, base[active[who]] - 2.0 * np.maximum(best[active[who], -1], known[active[who]])))
                return active[who[bound <= found * (1 + 1e-12) + 1e-9]]

            mine, other = np.flatnonzero(inner), np.flatnonzero(~inner)
            visit(halves[0][2], reach(halves[0], mine))
            visit(halves[1][2], reach(halves[1], other))
            visit(halves[1][2], reach(halves[1], mine))
            visit(halves[0][2], reach(halves[0], other))

        visit(self.root, np.arange(len(q)))
        return best, pos


def augmented(x: np.ndarray, largest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, largest**2 - np.einsum("ij,ij->i", x, x)))])


def may_hold(q: np.ndarray, centres: np.ndarray, radius: np.ndarray, largest: float, known: np.ndarray, factor: float) -> np.ndarray:
    """Row i, column s: whether the ball around centre s may hold a vector whose product with query i is over ``known``."""
    lower = np.maximum(0.0, distances(np.column_stack([q, np.zeros(len(q))]), centres) - radius[None, :])
    far = np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", q, q) + largest**2 - 2.0 * np.maximum(known, -1e300)))
    return lower * factor <= far[:, None] * (1 + 1e-12) + 1e-6


def nearest(df: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, factor: float = 1.0, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``df`` where ``queries`` holds, its ``k`` nearest others.

    Equal vectors are indexed once, with their k + 1 smallest ids, beyond which none can be asked for. Centres are chosen
    farthest first on a sample; a ball of many vectors is several shards. A shard's tree is built once and written. It
    meets the queries that look there block by block; a task holds a tree and ``block`` queries, about, and gives out k
    vectors for each. The driver gets the sample and a row for each shard.
    """
    spark = df.sparkSession
    raw, dtype = raw_vectors(df.where(F.col(id_col).isNotNull()), id_col, vec_col)
    rows = materialize(raw.select("id", "raw", F.sha2("raw", 256).alias("digest")), "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    first = F.row_number().over(Window.partitionBy("digest").orderBy("id"))
    classes = rows.withColumn("r", first).where(F.col("r") <= k + 1)
    classes = classes.groupBy("digest").agg(F.any_value("raw").alias("raw"), F.sort_array(F.collect_list("id")).alias("ids"))
    classes = materialize(classes, "classes")
    asked = rows.join(df.where(queries).select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    asked = materialize(asked.groupBy("id").agg(F.min_by("raw", "digest").alias("raw")), "asked")
    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.octet_length("raw")), F.lit(0))).first()
    width //= dtype.itemsize

    def norms(frames):
        for f in frames:
            if len(f):
                x = matrix(f["raw"], dtype)
                yield f[["raw"]].iloc[:1].assign(norm=float(np.sqrt(np.einsum("ij,ij->i", x, x).max())))[["norm"]]

    largest = classes.select("raw").mapInPandas(norms, "norm double").agg(F.coalesce(F.max("norm"), F.lit(0.0))).first()[0]
    sample = [x.raw for x in classes.select("digest", "raw").orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE).collect()]
    centres = spread(augmented(matrix(sample, dtype, width), largest), min(CENTRES, -(-n // shard)), 0.0) if sample else np.zeros((1, width + 1))

    def at_home(frames):
        for f in frames:
            if len(f):
                d = distances(augmented(matrix(f["raw"], dtype, width), largest), centres)
                home = d.argmin(axis=1)
                yield f.assign(ball=home.astype("int32"), dist=d[np.arange(len(d)), home])

    homes = materialize(classes.mapInPandas(at_home, f"digest string, raw binary, ids array<{kind}>, ball int, dist double"), "homes")
    balls = {x.ball: x for x in homes.groupBy("ball").agg(F.max("dist").alias("radius"), F.count("*").alias("n")).collect()}
    radius = np.array([balls[c].radius if c in balls else -np.inf for c in range(len(centres))])
    parts = np.array([-(-balls[c].n // shard) if c in balls else 0 for c in range(len(centres))])
    start = np.cumsum(parts) - parts  # number of a ball's first shard

    def build(f):
        import pandas as pd

        f = f.sort_values("raw")
        x = augmented(matrix(f["raw"], dtype, width), largest)
        return pd.DataFrame({"shard": f["shard"].iloc[:1], "tree": [pickle.dumps((Tree(np.ascontiguousarray(x[:, :-1]), x[:, -1]), f["ids"].tolist()))]})

    table = spark.createDataFrame([(c, int(parts[c]), int(start[c])) for c in balls], "ball int, parts int, start int")
    place = (F.col("start") + F.pmod(F.xxhash64("digest"), F.col("parts").cast("long"))).cast("int")
    trees = homes.join(F.broadcast(table), "ball").select(place.alias("shard"), "raw", "ids")
    trees = materialize(trees.groupBy("shard").applyInPandas(build, "shard int, tree binary"), "trees")

    def route(again: bool):
        def run(frames):
            for f in frames:
                if not len(f) or not parts.any():
                    continue
                q, known = matrix(f["raw"], dtype, width), f["known"].to_numpy(dtype=float, na_value=-np.inf)
                d = np.where(parts > 0, distances(np.column_stack([q, np.zeros(len(q))]), centres), np.inf)
                home = d.argmin(axis=1)
                # Of several shards of the nearest ball, the first look is into one.
                one = start[home] + np.array([zlib.crc32(r) for r in f["raw"]]) % parts[home]
                if not again:
                    yield f.assign(shard=one.astype("int32"))
                    continue
                who, ball = np.nonzero(may_hold(q, centres, radius, largest, known, factor) & (parts > 0)[None, :])
                who, to = np.repeat(who, parts[ball]), np.concatenate([start[b] + np.arange(parts[b]) for b in ball] or [np.zeros(0, int)])
                other = to != one[who]
                yield f.iloc[who[other]].assign(shard=to[other].astype("int32"))

        return run

    def find(tree, f):
        import pandas as pd

        if not len(tree) or not len(f):
            return pd.DataFrame({"query_id": [], "ids": pd.Series([], dtype=object), "score": []})
        t, ids = pickle.loads(tree["tree"].iloc[0])
        q, known = matrix(f["raw"], dtype, width), f["known"].to_numpy(dtype=float, na_value=-np.inf)
        # One more than asked for: the query's own vector may be among them.
        _, pos = t.search(q, k + 1, largest, factor, known)
        which, col = np.nonzero(pos >= 0)
        hit = pos[which, col]
        score = np.concatenate([np.einsum("ij,ij->i", q[which[i : i + 65536]], t.x[hit[i : i + 65536]]) for i in range(0, len(hit), 65536)] or [np.zeros(0)])
        new = score >= known[which] - 1e-9 * np.abs(known[which])
        return pd.DataFrame({"query_id": f["id"].to_numpy()[which[new]], "ids": pd.Series([ids[i] for i in hit[new]], dtype=object), "score": score[new]})

    def look(routed: DataFrame) -> DataFrame:
        routed = materialize(routed, "routed")
        blocks = F.ceil(F.count("*") / block).cast("int").alias("blocks")
        blocks = F.broadcast(routed.groupBy("shard").agg(blocks))  # a row for each shard
        b = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int").alias("b")
        ask = routed.join(blocks, "shard").select("shard", b, "id", "raw", "known")
        index = trees.join(blocks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "tree")
        met = index.groupBy("shard", "b").cogroup(ask.groupBy("shard", "b"))
        return materialize(met.applyInPandas(find, f"query_id {kind}, ids array<{kind}>, score double"), "found")

    schema = f"id {kind}, raw binary, known double, shard int"
    near = look(asked.select("id", "raw", F.lit(None).cast("double").alias("known")).mapInPandas(route(False), schema))
    known = near.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") > k, F.min("score")).alias("known"))
    rest = look(asked.join(known, "id", "left").select("id", "raw", "known").mapInPandas(route(True), schema))
    found = near.unionByName(rest).select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
