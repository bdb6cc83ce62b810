"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is split into blocks; fingerprints that differ in at most k bits agree in all but k of them. For every
choice of blocks that may be the agreeing ones, rows are joined on those blocks and the Hamming distance is verified.

Defined results: null text counts as empty; a text without words has fingerprint zero and links like any other;
repeated rows are copies of each other; a null id takes part, but is no component's name unless nothing else is
there; columns other than the id and the text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import components, join_counted, materialize, text_batches, tidied

SEED = 42
#: Fingerprints of one bucket that are compared in one place; larger buckets are split in chunks of about this size.
CHUNK = 1024
#: Buckets up to this size are joined as rows.
SMALL = 16

_words = re.compile(rb"[^\x20\x09-\x0d]+")
_lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence if it is shorter than a shingle."""
    import xxhash

    found = _words.findall((text or "").encode("utf-8", "replace").translate(_lower))
    if not found:
        return np.zeros(0, dtype="<u8")
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(found) - words + 1)
    return np.fromiter((digest(join(found[i : i + words]), seed) for i in range(n)), dtype="<u8", count=n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = SEED, distinct: bool = False) -> DataFrame:
    """``id_col, fp``: each whole text's fingerprint as a signed long. ``distinct``: each different shingle counts once."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text"):
                h = shingle_hashes(t.as_py(), words, seed)
                out.append(fingerprint(np.unique(h) if distinct else h))
            fp = pa.array(np.array(out, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), fp], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), f"id {rows.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def block_masks(max_distance: int, blocks: int, bits: int = 64) -> list[int]:
    """For each choice of ``blocks - max_distance`` blocks, the bits in them, as signed longs."""
    if not 0 <= max_distance < blocks:
        raise ValueError("there must be more blocks than differing bits")
    edges = [bits * i // blocks for i in range(blocks + 1)]
    one = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in itertools.combinations(one, blocks - max_distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, max_distance: int = 2, blocks: int = 4) -> DataFrame:
    """``src, dst`` between distinct fingerprints (column ``fp``) that differ in at most ``max_distance`` bits, enough
    of them to join whatever is joined by all.

    Small buckets are joined as rows. A bucket of more than ``SMALL`` fingerprints is split by hash into chunks, every
    pair of its chunks is compared in one place, and a spanning forest of the links found there is given out: no task
    holds more than about two chunks, and no more rows come out than went in.
    """
    masks = block_masks(max_distance, blocks)
    choice = F.array(*(F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)))
    keyed = fps.select("fp", F.explode(choice).alias("c")).select("fp", "c.k", "c.v")
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    keyed = materialize(keyed.join(sizes, ["k", "v"]), "buckets")

    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_distance
    few = keyed.where(F.col("n") <= SMALL)
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.fp") < F.col("b.fp")) & near)
    pairs = pairs.select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))

    many = keyed.where(F.col("n") > SMALL).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks").cast("long")).cast("int"))
    many = many.select("k", "v", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    many = many.select("k", "v", "fp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def forest(rows):
        import pandas as pd

        fp = rows["fp"].to_numpy()
        side = (rows["own"] == rows["i"]).to_numpy()
        within = bool((rows["i"] == rows["j"]).all())
        a, b = (fp, fp) if within else (fp[side], fp[~side])
        found = spanning(a.view(np.uint64)[:, None], b.view(np.uint64)[:, None], max_distance)
        return pd.DataFrame({"src": a[found[0]], "dst": b[found[1]]})

    rest = many.groupBy("k", "v", "i", "j").applyInPandas(forest, "src long, dst long")
    return pairs.unionByName(rest).distinct()


def spanning(a: np.ndarray, b: np.ndarray, max_distance: int) -> tuple[list[int], list[int]]:
    """Positions in a and b (fingerprints as rows of 64-bit words) of links that join all that links between them join."""
    root: dict[bytes, bytes] = {}
    names = [x.tobytes() for x in b]

    def find(x: bytes) -> bytes:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = root[x]
        return x

    left, right = [], []
    for i, x in enumerate(a):
        name = x.tobytes()
        for j in np.flatnonzero(np.bitwise_count(b ^ x).sum(axis=1) <= max_distance).tolist():
            p, q = find(name), find(names[j])
            if p != q:
                root[q] = p
                left.append(i)
                right.append(j)
    return left, right


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_distance: int = 2, blocks: int = 4, seed: int = SEED) -> DataFrame:
    """``id_col, fp, component_id``: the least id of all documents whose fingerprints are linked, directly or not.

    Fingerprints are computed where texts are read and kept in the shared folder; all that follows handles distinct
    fingerprints, so copies cost nothing, and links of different fingerprints only.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("rows")), "classes")
    found = components(links(classes.select("fp"), max_distance, blocks)).withColumnRenamed("node", "fp")
    linked = materialize(classes.join(found, "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    linked = join_counted(linked.drop("least"), least, "root", "n", linked.count()).select("fp", "rows", "component_id")
    alone = classes.join(found.select("fp"), "fp", "left_anti").select("fp", "rows", F.col("least").alias("component_id"))
    named = materialize(linked.unionByName(alone), "named")
    return join_counted(prints, named, "fp", "rows", prints.count()).select(id_col, "fp", "component_id")
