"""Chunks of moments for a model to read, their contents and their fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import fingerprint, mmss

FRAMES_PER_CALL = 8
OCR_MOST = 1500


def numbered(rows: DataFrame, size: int = FRAMES_PER_CALL, by: Sequence[str] = ("run_id",), order: Sequence[str] = ("start",), out: str = "chunk") -> DataFrame:
    """``rows`` with ``chunk``: windows of ``size`` rows in order, the last one possibly shorter."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn(out, F.floor(place / size).cast("int"))


def speaker_changes(rows: DataFrame, by: Sequence[str], order: Sequence[str], speaker: str = "speaker", text: str = "text") -> DataFrame:
    """``rows`` with text, and ``line``: the speaker's name in front where it changes. A row without a speaker doesn't
    reset who spoke last."""
    rows = rows.where(F.trim(text) != "")
    named = F.when(F.col(speaker) != "", F.col(speaker))
    before = F.last(named, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    changed = named.isNotNull() & ~named.eqNullSafe(before)
    return rows.withColumn("line", F.when(changed, F.concat(named, F.lit(": "), F.trim(text))).otherwise(F.trim(text)))


def spoken(segments: Column) -> Column:
    """What is said in an array of segments, by the same rule, in one expression."""
    def step(a, s):
        text, name = F.trim(F.coalesce(s.text, F.lit(""))), F.when(s.speaker != "", s.speaker)
        line = F.when(name.isNotNull() & ~name.eqNullSafe(a.who), F.concat(name, F.lit(": "), text)).otherwise(text)
        said = F.struct(F.concat(a.out, F.array(line)).alias("out"), F.coalesce(name, a.who).alias("who"))
        return F.when(text == "", a).otherwise(said)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("who"))
    return F.aggregate(segments, start, step, lambda a: F.array_join(a.out, " "))


def transcript(segments: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """``by, transcript``: a line ``[mm:ss] who: text`` for each segment with text, in order."""
    who = F.when(F.col("speaker") != "", F.concat("speaker", F.lit(": "))).otherwise("")
    line = F.concat(F.lit("["), mmss(F.col("start")), F.lit("] "), who, F.trim("text"))
    lines = segments.where(F.trim("text") != "").select(*by, F.struct("pos", line.alias("line")).alias("x"))
    return lines.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x.line), "\n").alias("transcript"))


def first_seen(rows: DataFrame, key: str, by: Sequence[str] = ("run_id",), order: Sequence[str] = ("chunk", "pos")) -> DataFrame:
    """The first row of each key in a run: what was known from there on."""
    w = Window.partitionBy(*by, key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def known_before(rows: DataFrame, chunks: DataFrame, key: str, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """``by, chunk, known``: for each chunk, how many keys earlier chunks have shown."""
    new = first_seen(rows, key, by).groupBy(*by, "chunk").agg(F.count("*").alias("_new"))
    all_ = chunks.select(*by, "chunk").distinct().join(new, [*by, "chunk"], "left")
    w = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return all_.select(*by, "chunk", F.coalesce(F.sum("_new").over(w), F.lit(0)).cast("bigint").alias("known"))


def keys(moments: DataFrame) -> DataFrame:
    """``run_id, chunk, key``: a fingerprint of what a chunk shows: frames, times to hundredths, and words."""
    part = F.struct("start", F.struct("index", F.bround("start", 2).alias("s"), F.bround("end", 2).alias("e"), spoken(F.col("segments")).alias("t")).alias("x"))
    per = moments.groupBy("run_id", "chunk").agg(F.transform(F.sort_array(F.collect_list(part)), lambda p: p.x).alias("parts"))
    return per.select("run_id", "chunk", fingerprint(F.col("parts")).alias("key"))


def unread(chunk_keys: DataFrame, readings: DataFrame) -> DataFrame:
    """Chunks whose contents no earlier reading has: the others are reused."""
    return chunk_keys.join(readings.select("key").distinct(), "key", "left_anti")


def ocr_text(text: Column) -> Column:
    t = F.trim(text)
    cut = F.concat(F.rtrim(F.left(t, F.lit(OCR_MOST))), F.lit("\n[cut: the frame has more text than shown here]"))
    return F.when(F.length(t) > OCR_MOST, cut).otherwise(t)


def requests(moments: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """``run_id, chunk, frames, parts, text``: what each chunk asks a model to read, part by part and as one text."""
    rows = moments
    if ocr is not None:
        rows = rows.join(ocr.select("run_id", "index", F.col("text").alias("_ocr")), ["run_id", "index"], "left")
    else:
        rows = rows.withColumn("_ocr", F.lit(None).cast("string"))
    said = spoken(F.col("segments"))
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("Frame "), F.col("index").cast("string"), F.lit(" from "), mmss(F.col("start")), F.lit(" to "), mmss(F.col("end"))),
        F.concat(F.lit("Said: "), F.when(said == "", "(nothing said)").otherwise(said)),
        F.when(F.col("_ocr") != "", F.concat(F.lit("On screen: "), ocr_text(F.col("_ocr")))),
    )
    item = F.struct("start", F.col("index").alias("i"), body.alias("b"))
    per = rows.groupBy("run_id", "chunk").agg(F.sort_array(F.collect_list(item)).alias("x"))
    return per.select("run_id", "chunk", F.transform("x", lambda x: x.i).alias("frames"), F.transform("x", lambda x: x.b).alias("parts"), F.array_join(F.transform("x", lambda x: x.b), "\n\n").alias("text"))
