"""Embedding near-duplicates by an exact metric range join.

Unit vectors with cosine c lie at distance sqrt(2 - 2c). Pivots, far from each other, partition them into cells; the
triangle inequality says which vectors near a cell's border must be given to the neighbouring cell as well; then cells
join independently, and of a cell's vectors only those are compared whose distances to its pivot are near enough.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
their own component; of vectors of different lengths the shorter counts as filled up with zeros; equal vectors link
with each other; repeated rows are vectors of their own; a null id takes part, but names a component only where no
other id is in it; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import components, join_counted, materialize
from tracewright.llm.vectors import distances, matrix, raw_vectors, spread, unit

#: Vectors that pivots are chosen from; they are sent to the driver.
SAMPLE = 16_384
#: Vectors of a cell, about, and the least and the most pivots. More pivots make cells smaller and copies more: fewer than
#: one for every ``CELL`` are taken where a vector of the sample would have over ``COPIES`` copies on average.
CELL, PIVOTS, COPIES = 2048, (8, 4096), 4.0
#: Vectors on either side of one comparison at most, about; larger cells are split.
CHUNK = 8192
#: Rows that are compared at once.
BLOCK = 128
_SLACK = 1e-6


def _copies(d: np.ndarray, home: np.ndarray, between: np.ndarray, reach: np.ndarray, r: float) -> np.ndarray:
    """Whether vector x has to be given to cell j: j comes before its own cell i, the plane between the pivots of i
    and j is within r of x (beyond it lies all of j), and so is the ball that holds j."""
    own = d[np.arange(len(d)), home][:, None]
    near = d**2 - own**2 <= 2 * r * between[home] + _SLACK
    return near & (d <= reach[None, :] + r + _SLACK) & (np.arange(d.shape[1])[None, :] < home[:, None])


def choose_pivots(sample: np.ndarray, n: int, r: float) -> np.ndarray:
    """Farthest first: each pivot is the vector of the sample that is farthest from those before, until there is one for
    every ``CELL`` of the ``n`` vectors, or none is farther than ``r``; the first half of them, again and again, while
    that many would give a vector over ``COPIES`` copies."""
    p = spread(sample, min(max(PIVOTS[0], -(-n // CELL)), PIVOTS[1]), r)
    some = sample[:: max(1, len(sample) // 2048)]
    while len(p) > PIVOTS[0]:
        d = distances(some, p)
        home = d.argmin(axis=1)
        reach = np.array([d[home == j, j].max(initial=0.0) for j in range(len(p))])
        if _copies(d, home, distances(p, p), reach, r).sum() <= COPIES * len(some):
            break
        p = p[: max(PIVOTS[0], len(p) // 2)]
    return p


def join_cells(df: DataFrame, id_col: str, vec_col: str, cosine: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows`` (id, cls) of the vectors that take part, ``classes`` (cls, n, least) of equal ones, and ``found`` (src, dst,
    n): with dst null, n linked vectors of class src; with dst, a link that holds components together; with src null, n
    pairs of classes were compared.

    Equal vectors are one class from the start, so a hot vector costs one row. A cell of more than ``CHUNK`` vectors,
    its own or given ones, is split by hash and compared chunk by chunk. A comparison gives out link counts per class
    and a spanning forest of its links, so output follows the number of vectors, not of links.
    """
    r = float(np.sqrt(2.0 - 2.0 * cosine))
    raw, dtype = raw_vectors(df, id_col, vec_col)
    rows = materialize(raw.select("id", "raw", F.unhex(F.substring(F.sha2("raw", 256), 1, 32)).alias("cls")), "vectors")
    classes = rows.groupBy("cls").agg(F.any_value("raw").alias("raw"), F.count("*").alias("n"), F.min("id").alias("least"))
    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.octet_length("raw")), F.lit(0))).first()
    width //= dtype.itemsize
    sample = [x.raw for x in classes.select("cls", "raw").orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).collect()]
    pivots = choose_pivots(unit(matrix(sample, dtype, width)), n, r) if sample else np.zeros((1, 1))

    def at_home(frames):
        for f in frames:
            if len(f):
                d = distances(unit(matrix(f["raw"], dtype, width)), pivots)
                home = d.argmin(axis=1)
                yield f.assign(home=home.astype("int32"), dist=d[np.arange(len(d)), home])

    homes = classes.mapInPandas(at_home, "cls binary, raw binary, n long, least " + rows.schema["id"].dataType.simpleString() + ", home int, dist double")
    homes = materialize(homes, "cells")
    reach = np.zeros(len(pivots))
    for x in homes.groupBy("home").agg(F.max("dist").alias("dist")).collect():  # a row per pivot
        reach[x.home] = x.dist
    between = distances(pivots, pivots)

    def given(frames):
        for f in frames:
            if len(f):
                d = distances(unit(matrix(f["raw"], dtype, width)), pivots)
                which, cell = np.nonzero(_copies(d, f["home"].to_numpy(), between, reach, r))
                yield f.iloc[which].assign(cell=cell.astype("int32"), dist=d[which, cell])[["cls", "raw", "n", "cell", "dist"]]

    own = homes.select("cls", "raw", "n", F.col("home").alias("cell"), "dist", F.lit(False).alias("guest"))
    if len(pivots) > 1:
        guests = homes.select("cls", "raw", "n", "home").mapInPandas(given, "cls binary, raw binary, n long, cell int, dist double")
        own = own.unionByName(guests.withColumn("guest", F.lit(True)))
    cells = materialize(own, "joined")
    # A row per cell; cells without guests have a chunk count of 0 for them.
    counts = cells.groupBy("cell").agg(
        F.ceil(F.count(F.when(~F.col("guest"), 1)) / CHUNK).cast("int").alias("own_chunks"), F.ceil(F.count(F.when(F.col("guest"), 1)) / CHUNK).cast("int").alias("guest_chunks")
    )
    dealt = cells.join(F.broadcast(counts), "cell")
    chunks = F.when(F.col("guest"), F.col("guest_chunks")).otherwise(F.col("own_chunks"))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("cls"), chunks.cast("long")).cast("int"))
    some = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    to_own = F.transform(some(F.col("own_chunks")), lambda b: F.struct(F.lit(0).alias("kind"), F.least(b, F.col("c")).alias("i"), F.greatest(b, F.col("c")).alias("j")))
    to_guests = F.transform(some(F.col("guest_chunks")), lambda b: F.struct(F.lit(1).alias("kind"), F.col("c").alias("i"), b.alias("j")))
    from_guest = F.transform(some(F.col("own_chunks")), lambda b: F.struct(F.lit(1).alias("kind"), b.alias("i"), F.col("c").alias("j")))
    dealt = dealt.withColumn("t", F.explode(F.when(F.col("guest"), from_guest).otherwise(F.concat(to_own, to_guests))))
    dealt = dealt.select("cell", "t.kind", "t.i", "t.j", "cls", "raw", "n", "dist", ((F.col("t.kind") == 0) & (F.col("c") == F.col("t.i")) | (F.col("t.kind") == 1) & ~F.col("guest")).alias("left"))

    def compare(f):
        import pandas as pd

        f = f.sort_values("dist")
        cls, n, left, dist = f["cls"].to_numpy(), f["n"].to_numpy(), f["left"].to_numpy(), f["dist"].to_numpy()
        x = unit(matrix(f["raw"], dtype, width))
        same = f["kind"].iloc[0] == 0 and f["i"].iloc[0] == f["j"].iloc[0]
        a = np.arange(len(f)) if same else np.flatnonzero(left)
        b = a if same else np.flatnonzero(~left)
        total, src, dst, pairs = compare_vectors(x, n, dist, a, b, cosine, same)
        hit = np.flatnonzero(total)
        parts = [{"src": cls[hit], "dst": None, "n": total[hit]}, {"src": cls[src], "dst": cls[dst], "n": 0}, {"src": [None], "dst": [None], "n": [pairs]}]
        return pd.concat([pd.DataFrame(p) for p in parts])

    found = dealt.groupBy("cell", "kind", "i", "j").applyInPandas(compare, "src binary, dst binary, n long")
    found = materialize(found, "found")
    return rows.select("id", "cls"), homes.select("cls", "n", "least"), found


def link(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """``id_col, n_links, component_id, kept``; linked are all pairs of cosine ``cosine`` or more, and no others."""
    rows, classes, found = join_cells(df, id_col, vec_col, cosine)
    links = found.where("src is not null and dst is null").groupBy(F.col("src").alias("cls")).agg(F.sum("n").alias("links"))
    roots = components(found.where("dst is not null")).withColumnRenamed("node", "cls")
    linked = materialize(classes.join(links, "cls").join(roots, "cls"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("in_root"))
    linked = join_counted(linked, least, "root", "in_root", linked.count()).select("cls", "n", "links", "component")
    alone = classes.join(links.select("cls"), "cls", "left_anti").select("cls", "n", F.lit(0).cast("long").alias("links"), F.col("least").alias("component"))
    named = materialize(linked.unionByName(alone).select("cls", "n", (F.col("links") + F.col("n") - 1).alias("links"), "component"), "named")
    good = join_counted(rows, named, "cls", "n", rows.count()).select("id", "links", "component")
    # The rest: as many rows of an id as didn't take part.
    rest = df.select(F.col(id_col).alias("id")).groupBy("id").agg(F.count("*").alias("all"))
    took = rows.groupBy("id").agg(F.count("*").alias("took"))
    rest = rest.join(took.withColumnRenamed("id", "other"), F.col("id").eqNullSafe(F.col("other")), "left").where("all > coalesce(took, 0)")
    rest = rest.select("id", F.expr("explode(sequence(1L, all - coalesce(took, 0L)))").alias("x")).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = good.unionByName(rest)
    kept = F.col("id").eqNullSafe(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), kept.alias("kept"))


def compare_vectors(x: np.ndarray, n: np.ndarray, dist: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, list, list, int]:
    """Linked copies per row, a spanning forest of the links, and how many pairs were compared, between rows ``a`` and
    ``b`` of unit vectors, both in the order of ``dist``, their distance to one pivot: vectors whose distances differ by
    more than the range can't be linked.

    Single precision finds candidates with a margin above its error; double precision decides."""
    total, label = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    x32 = x.astype(np.float32)
    r = float(np.sqrt(2.0 - 2.0 * cosine)) + _SLACK
    src, dst, pairs = [], [], 0
    for s in range(0, len(a), BLOCK):
        rows = a[s : s + BLOCK]
        first, last = np.searchsorted(dist[b], [dist[rows[0]] - r, dist[rows[-1]] + r], side="left")
        cols = b[max(s, first) : last + 1] if same else b[first : last + 1]
        if not len(cols):
            continue
        pairs += len(rows) * len(cols)
        i, j = np.nonzero(x32[rows] @ x32[cols].T >= cosine - 1e-4)
        i, j = rows[i], cols[j]
        if same:
            i, j = i[j > i], j[j > i]
        sure = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) >= cosine for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        i, j = i[sure], j[sure]
        np.add.at(total, i, n[j])
        np.add.at(total, j, n[i])
        if not len(i):
            continue
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        for at, end in zip(starts, [*starts[1:], len(i)], strict=True):
            row, mates = i[at], j[at:end]
            others, first = np.unique(label[mates], return_index=True)
            new = others != label[row]
            if new.any():
                src += [row] * int(new.sum())
                dst += mates[first[new]].tolist()
                label[np.isin(label, others[new])] = label[row]
    return total, src, dst, pairs
