"""Alignment of frames and speech: as-of, interval, first-match and most-overlap joins.

Frames ``(run_id, index, timestamp)``; segments ``(run_id, pos, start, end, text, speaker, words)``. All plans are
equi-joins and windows on ``run_id``; where a run alone may be too large for a task the keys given take its place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(frames: DataFrame, durations: DataFrame | None = None, by: Sequence[str] = ("run_id",), at: str = "timestamp") -> DataFrame:
    """``frames`` with ``start`` and ``end``: a frame owns the time up to the next one; the last up to the run's
    ``duration``, if that is later than itself."""
    following = F.lead(at).over(Window.partitionBy(*by).orderBy(at, "index"))
    if durations is not None:
        frames = frames.join(durations.select(*by, "duration"), list(by), "left")
    else:
        frames = frames.withColumn("duration", F.lit(None).cast("double"))
    last = F.greatest(F.col("duration"), F.col(at))
    return frames.withColumn("start", F.col(at)).withColumn("end", F.coalesce(following, last, F.col(at))).drop("duration")


def asof(points: DataFrame, frames: DataFrame, by: Sequence[str], point_at: str, frame_at: str, frame_cols: Sequence[str], clamp: bool = False) -> DataFrame:
    """``points`` with the columns ``frame_cols`` of the last frame at or before each; a point at a frame's time
    belongs to it. Before the first frame: that frame if ``clamp``, else nulls.

    One sort of both tables together instead of a range join: frames come before points of the same time, and the last
    frame seen is carried along.
    """
    owned = F.struct(*(F.col(c) for c in frame_cols))
    keys = list(by)
    tagged = frames.select(*keys, F.col(frame_at).alias("_at"), F.lit(0).alias("_kind"), owned.alias("_frame"), F.lit(None).cast(points.schema.simpleString()).alias("_row"))
    rows = points.select(*keys, F.col(point_at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(tagged.schema["_frame"].dataType).alias("_frame"), F.struct(*points.columns).alias("_row"))
    order = Window.partitionBy(*keys).orderBy("_at", "_kind")
    found = F.last("_frame", ignorenulls=True).over(order)
    if clamp:
        found = F.coalesce(found, F.first("_frame", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = tagged.unionByName(rows).withColumn("_found", found).where("_kind = 1")
    return out.select("_row.*", *(F.col(f"_found.{c}").alias(c) for c in frame_cols))


def first_closed(points: DataFrame, moments: DataFrame, by: Sequence[str], at: str, cols: Sequence[str], bucket: float = 60.0) -> DataFrame:
    """``points`` with ``cols`` of the first moment (least ``pos``) whose closed interval holds each: a boundary
    belongs to the earlier one; nulls where none does.

    Moments are cut into buckets of ``bucket`` seconds, so the join is on (keys, bucket) and then on the interval.
    """
    keys = list(by)
    slot = lambda c: F.floor(c / bucket)
    cut = moments.select(*keys, "pos", "start", "end", *(F.col(c).alias(f"_m_{c}") for c in cols)).withColumn("_slot", F.explode(F.sequence(slot(F.col("start")), slot(F.col("end")))))
    rows = points.withColumn("_slot", slot(F.col(at)))
    joined = rows.join(cut, [*keys, "_slot"], "left")
    inside = F.col(at).between(F.col("start"), F.col("end"))
    found = F.min(F.when(inside, F.struct("pos", *(f"_m_{c}" for c in cols)))).alias("_found")
    out = joined.groupBy(*points.columns).agg(found)
    return out.select(*points.columns, *(F.col(f"_found._m_{c}").alias(c) for c in cols))


def most_overlap(segments: DataFrame, turns: DataFrame, by: Sequence[str], label: str, bucket: float = 60.0) -> DataFrame:
    """``segments`` with ``label`` of the turn that overlaps each the longest, the earliest (least ``pos``) of equals;
    null where none does. Joined by buckets of time as in ``first_closed``."""
    keys = list(by)
    slot = lambda c: F.floor(c / bucket)
    cut = lambda df: df.withColumn("_slot", F.explode(F.sequence(slot(F.col("start")), slot(F.greatest("end", "start")))))
    right = cut(turns.select(*keys, "pos", "start", "end", label)).select(*keys, "_slot", *(F.col(c).alias(f"_t_{c}") for c in ("pos", "start", "end", label)))
    joined = cut(segments).join(right, [*keys, "_slot"], "left")
    shared = F.least("end", "_t_end") - F.greatest("start", "_t_start")
    best = F.max(F.when(F.col("_t_start").isNotNull() & (shared > 0), F.struct(shared.alias("n"), (-F.col("_t_pos")).alias("p"), F.col(f"_t_{label}").alias("v"))))
    out = joined.groupBy(*segments.columns).agg(best.alias("_best"))
    return out.select(*segments.columns, F.col("_best.v").alias(label))


def estimated_words(segments: DataFrame) -> DataFrame:
    """A row per word of each segment without word times: ``word_pos``, ``word``, ``word_start``, ``word_end``. A word
    takes its share of the characters of the segment's time, rounded to milliseconds; the last ends with it."""
    text = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    words = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))
    out = segments.select("*", F.posexplode(words).alias("word_pos", "word"))
    of = Window.partitionBy("run_id", "pos")
    upto, total = F.sum(F.length("word")).over(of.orderBy("word_pos")), F.sum(F.length("word")).over(of)
    span = F.greatest(F.col("end") - F.col("start"), F.lit(0.0))
    last = F.lead("word_pos").over(of.orderBy("word_pos")).isNull()
    out = out.withColumn("word_end", F.when(last, F.col("end")).otherwise(F.bround(F.col("start") + span * upto / total, 3)))
    return out.withColumn("word_start", F.coalesce(F.lag("word_end").over(of.orderBy("word_pos")), F.col("start")))


def moments(frames: DataFrame, segments: DataFrame, durations: DataFrame | None = None, estimate: bool = True) -> DataFrame:
    """``run_id, index, start, end, segments``: a row per frame, with or without speech, and the pieces of segments
    that fall on it, in transcript order.

    A segment with words is cut where words start on another frame; one without gets estimated words if a frame starts
    strictly inside it, else it goes whole to the frame that owns its middle. Times before the first frame belong to
    that frame. A piece keeps the segment's outer times and takes those of its first and last word at a cut.
    """
    frames = intervals(frames.select("run_id", "index", "timestamp"), durations)
    bounds = frames.groupBy("run_id").agg(F.sort_array(F.collect_list("timestamp")).alias("_starts"))
    seg = segments.join(bounds, "run_id", "left").withColumn("_starts", F.coalesce("_starts", F.array().cast("array<double>")))
    crossed = F.exists("_starts", lambda b: (b > F.try_element_at("_starts", F.lit(1))) & (F.col("start") < b) & (b < F.col("end")))
    given = F.size("words") > 0
    seg = seg.withColumn("_mode", F.when(given, "words").when(F.lit(estimate) & crossed & (F.trim("text") != ""), "estimate").otherwise("whole")).drop("_starts")
    outer = ["run_id", "pos", "start", "end", "text", "speaker", "words"]
    of_words = seg.where("_mode = 'words'").select(*outer, F.posexplode("words").alias("word_pos", "w"))
    of_words = of_words.select(*outer, "word_pos", F.col("w.text").alias("word"), F.col("w.start").alias("word_start"), F.col("w.end").alias("word_end"))
    guessed = estimated_words(seg.where("_mode = 'estimate'").select(*outer))
    words = of_words.unionByName(guessed.select(of_words.columns))
    placed = asof(words, frames, ["run_id"], "word_start", "timestamp", ["index"], clamp=True)
    word = F.struct("word_pos", F.col("word_start").alias("start"), F.col("word_end").alias("end"), F.col("word").alias("text"))
    pieces = placed.groupBy("run_id", "pos", "index").agg(F.sort_array(F.collect_list(word)).alias("_w"), *(F.first(c).alias(c) for c in ("start", "end", "text", "speaker", "words")))
    whole = Window.partitionBy("run_id", "pos")
    pieces = pieces.withColumn("_n", F.count("*").over(whole)).withColumn("_from", F.min(F.col("_w")[0].word_pos).over(whole)).withColumn("_to", F.max(F.element_at("_w", -1).word_pos).over(whole))
    w_first, w_last = F.col("_w")[0], F.element_at("_w", -1)
    cut = F.col("_n") > 1
    bare = F.transform("_w", lambda w: F.struct(w.start.alias("start"), w.end.alias("end"), w.text.alias("text")))
    pieces = pieces.select(
        "run_id", "pos", "index", F.col("_w")[0].word_pos.alias("part"),
        F.when(cut & (w_first.word_pos > F.col("_from")), w_first.start).otherwise(F.col("start")).alias("start"),
        F.when(cut & (w_last.word_pos < F.col("_to")), w_last.end).otherwise(F.col("end")).alias("end"),
        F.when(cut, F.array_join(F.transform("_w", lambda w: w.text), " ")).otherwise(F.col("text")).alias("text"),
        "speaker", F.when(cut, bare).otherwise(F.col("words")).alias("words"),
    )
    middle = seg.where("_mode = 'whole'").withColumn("_mid", (F.col("start") + F.col("end")) / 2).select(*outer, "_mid")
    middle = asof(middle, frames, ["run_id"], "_mid", "timestamp", ["index"], clamp=True)
    rows = pieces.unionByName(middle.withColumn("part", F.lit(0)).select(pieces.columns))
    item = F.struct("pos", "part", "start", "end", "text", "speaker", "words")
    said = rows.groupBy("run_id", "index").agg(F.sort_array(F.collect_list(item)).alias("segments"))
    none = F.array().cast(said.schema["segments"].dataType)
    return frames.select("run_id", "index", "start", "end").join(said, ["run_id", "index"], "left").withColumn("segments", F.coalesce("segments", none))
