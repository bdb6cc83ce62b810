"""Packing token sequences by minimum bin slack.

The lengths still to be packed are a histogram over 1..window. Each step asks a bitset subset-sum program for the
multiset of remaining lengths that fills a window closest to capacity, walks back through the bitsets for the counts
of each length, and uses that filling as often as the histogram allows.

Defined results: null text counts as empty; an empty document still has its end id; repeated rows are packed once per
row; pieces of one length are taken in the order of their contents, and what is packed is written before it is given
out, so lost tasks change nothing; columns other than the id and the text are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.bpe import encoder, vocabulary_path
from tracewright.llm.common import materialize, text_batches, tidied

WINDOW = 2048
#: Pieces that a task holds at most before it packs what it has.
POOL = 16_384


def best_filling(counts: dict[int, int], window: int = WINDOW) -> dict[int, int]:
    """Length -> how often, for a multiset out of ``counts`` whose sum is as near below ``window`` as any is.

    Among those it holds the longest remaining length, so that no length is left for the end. Bit s of a bitset says
    that sum s can be reached; the bitsets from before each step are kept for the way back."""
    first = max(counts)
    bits, mask, steps = 1 << first, (1 << (window + 1)) - 1, []
    for n in sorted(counts, reverse=True):
        left, part = min(counts[n] - (n == first), window // n), 1
        while left > 0:  # counts by powers of two
            part = min(part, left)
            steps.append((n, part, bits))
            bits |= (bits << (n * part)) & mask
            left -= part
            part *= 2
        if bits >> window & 1:
            break
    total, used = bits.bit_length() - 1, {first: 1}
    for n, part, before in reversed(steps):
        if not before >> total & 1:
            used[n] = used.get(n, 0) + part
            total -= n * part
    return used


def fillings(counts: dict[int, int], window: int = WINDOW) -> Iterator[tuple[dict[int, int], int]]:
    """Fillings with how often each is used, until no length is left."""
    counts = {n: c for n, c in counts.items() if c > 0}
    while counts:
        used = best_filling(counts, window)
        times = min(counts[n] // k for n, k in used.items())
        yield used, times
        for n, k in used.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]


class _Pool:
    """Pieces by length, in the order in which they came."""

    def __init__(self):
        self.by_length: dict[int, list[tuple]] = {}
        self.n = 0

    def add(self, length: int, piece: tuple) -> None:
        self.by_length.setdefault(length, []).append(piece)
        self.n += 1

    def packed(self, window: int, everything: bool) -> Iterator[list[tuple[int, tuple]]]:
        """Sequences of (offset, piece); only full ones, unless everything is to go."""
        for used, times in fillings({n: len(p) for n, p in self.by_length.items()}, window):
            full = sum(n * k for n, k in used.items()) == window
            if not full and not everything:
                continue
            for _ in range(times):
                at, sequence = 0, []
                for n, k in used.items():
                    for _ in range(k):
                        sequence.append((at, self.by_length[n].pop()))
                        self.n -= 1
                        at += n
                yield sequence


FIELDS = "start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = 1, pool: int = POOL) -> DataFrame:
    """``id_col, start, length, doc_tokens, ids, sequence_id, offset``: the pieces of all documents.

    A document's ids, with ``end_id`` at their end, are cut at each multiple of ``window``; whole windows are sequences
    of their own. Each task packs its rests as it reads, ``pool`` at a time, and gives out the sequences that are full;
    what no task could fill, a small share unless lengths don't fit together, is dealt out evenly and packed in a second
    round. So most texts and ids aren't shuffled, and a task holds about ``pool`` rests at most in either round. Both
    are written to the shared folder once.
    """
    spark = docs.sparkSession
    text_batches(spark)
    path = path or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = materialize(rows.mapInArrow(tidied(_first(path, window, end_id, pool, rows.schema["id"].dataType)), f"id {kind}, {FIELDS}"), "packed")
    rest = first.where("sequence_id is null")
    tasks = max(1, -(-rest.count() // pool))
    # Dealt in turn, so that repeats of one row don't meet in one task; Spark orders the rows of a task before that.
    rest = rest.repartition(tasks).withColumn("crc", F.crc32("ids")).sortWithinPartitions("length", "id", "start", "crc").drop("crc")
    rest = materialize(rest.mapInArrow(tidied(_second(window, pool, rows.schema["id"].dataType)), f"id {kind}, {FIELDS}"), "rests")
    return first.where("sequence_id is not null").unionByName(rest).withColumnRenamed("id", id_col)


def _batch(rows: list[tuple], id_type) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    names = ["id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _first(path: str, window: int, end_id: int, pool_size: int, id_type):
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow, end = to_arrow_type(id_type), array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pool = encoder(path), _Pool()
        base, made = TaskContext.get().partitionId() << 36, 0

        def emit() -> list[tuple]:
            nonlocal made
            out = []
            for sequence in pool.packed(window, False):
                out += [(*p, base + made, at) for at, p in sequence]
                made += 1
            return out

        for b in batches:
            out = []
            for doc, ids in zip(b.column("id").to_pylist(), enc.encode_many(b.column("text").to_pylist()), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    if len(part) == 4 * window:
                        out.append((doc, start, window, total, part, base + made, 0))
                        made += 1
                    else:
                        pool.add(len(part) // 4, (doc, start, len(part) // 4, total, part))
            if pool.n >= pool_size:
                out += emit()
                if pool.n >= pool_size // 2:  # lengths that don't fit together, to be dealt out anew
                    yield _batch([(*p, None, None) for pieces in pool.by_length.values() for p in pieces], id_arrow)
                    pool = _Pool()
            yield _batch(out, id_arrow)
        yield _batch(emit(), id_arrow)
        yield _batch([(*p, None, None) for pieces in pool.by_length.values() for p in pieces], id_arrow)

    return run


def _second(window: int, pool_size: int, id_type):
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, base, made = _Pool(), (1 << 62) + (TaskContext.get().partitionId() << 36), 0

        def emit() -> pa.RecordBatch:
            nonlocal made
            out = []
            for sequence in pool.packed(window, everything=True):
                out += [(*p, base + made, at) for at, p in sequence]
                made += 1
            return _batch(out, id_arrow)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("id", "start", "length", "doc_tokens", "ids")), strict=True):
                pool.add(row[2], row)
            if pool.n >= 2 * pool_size:  # no more than some rows over ``pool_size`` were dealt to a task
                yield emit()
        yield emit()

    return run


def slack(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``sequences, tokens, padding``: what padding to ``window`` costs, sequences of a power of two being left as they are."""
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = (F.col("n").bitwiseAND(F.col("n") - 1)) == 0
    return per.agg(
        F.count("*").alias("sequences"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(power, 0).otherwise(window - F.col("n"))), F.lit(0)).alias("padding"),
    )
