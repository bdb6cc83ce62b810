"""Live sessions with Structured Streaming: frames kept as they come, rounds of analysis by recording time, folders
watched.

The decision to keep a frame is the same state machine as in batches (``operators.keyframes.Keeper``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.operators.keyframes import DISTANCE, MIN_GAP, Keeper

#: Files that are processed at the same time; what they start shares the cluster.
AT_A_TIME = 8
STATE = "hash string, t double, changed int, kept int"
KEPT = "run_id string, frame int, t double, hash string"


def keep(frames: DataFrame, distance: int = DISTANCE, min_gap: float = MIN_GAP) -> DataFrame:
    """``run_id, frame, t, hash`` of the frames kept, from a stream of ``(run_id, t, hash)``; frames are numbered across
    micro-batches. Within one, rows are taken by time; a frame older than the last one kept is left out, so the state
    of a run is one hash, one time and two counts."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        keeper = Keeper(distance, min_gap)
        if state.exists:
            h, t, keeper.changed, keeper.kept = state.get
            keeper.last = (h, t)
        out = []
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        for t, h in zip(rows["t"], rows["hash"], strict=True):
            if keeper.last and t < keeper.last[1]:
                continue
            if keeper.take(float(t), h):
                out.append((key[0], keeper.kept - 1, float(t), h))
        if keeper.last:
            state.update((*keeper.last, keeper.changed, keeper.kept))
        yield pd.DataFrame(out, columns=["run_id", "frame", "t", "hash"])

    return frames.groupBy("run_id").applyInPandasWithState(step, KEPT, STATE, "append", GroupStateTimeout.NoTimeout)


def progress(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts of arrivals by run and window of event time; late ones within the watermark still count."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "run_id").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


def shifted(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments of audio chunks, whose times count from the chunk's own start, in the time of the recording. ``chunks`` are
    ``(run_id, chunk, start)``; a segment of an unknown chunk stays as it is."""
    by = chunks.select("run_id", "chunk", F.col("start").alias("_by"))
    rows = segments.join(by, ["run_id", "chunk"], "left").withColumn("_by", F.coalesce("_by", F.lit(0.0)))
    out = rows.withColumns({c: F.col(c) + F.col("_by") for c in ("start", "end")})
    if "words" in segments.columns:
        out = out.withColumn("words", F.transform("words", lambda w: w.withField("start", w["start"] + F.col("_by")).withField("end", w["end"] + F.col("_by"))))
    return out.select(*segments.columns)


def rounds(events: DataFrame, every: float = 300.0) -> DataFrame:
    """``run_id, round, at``: an analysis is due each time the recording time of a run crosses a multiple of ``every``
    seconds, and once more at its end. Events are ``(run_id, t)``, frames at their time and speech at its end."""
    w = Window.partitionBy("run_id").orderBy("t")
    crossed = events.withColumn("_b", F.floor(F.col("t") / every)).withColumn("_p", F.coalesce(F.lag("_b").over(w), F.lit(0)))
    due = crossed.where("_b > _p").select("run_id", F.explode(F.sequence(F.col("_p") + 1, F.col("_b"))).alias("b"), "t")
    end = events.groupBy("run_id").agg(F.max("t").alias("t")).select("run_id", F.lit(None).cast("bigint").alias("b"), "t")
    last = due.groupBy("run_id").agg(F.max("t").alias("_last"))
    end = end.join(last, "run_id", "left").where("_last is null or t > _last").drop("_last")
    n = F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("b").isNull(), "b"))
    return due.unionByName(end).select("run_id", n.alias("round"), F.col("t").alias("at"))


def analyses_due(state: DataFrame, latest: DataFrame, every: float = 300.0, force: bool = False) -> DataFrame:
    """Runs whose analysis is due: none yet, ``every`` seconds of recording since the last, or, forced, anything new.
    ``latest`` is ``(run_id, at, frames, segments)``, ``state`` the same at the last analysis."""
    s = state.select("run_id", F.col("at").alias("_at"), F.col("frames").alias("_f"), F.col("segments").alias("_s"))
    j = latest.join(s, "run_id", "left")
    new = (F.col("frames") > F.coalesce("_f", F.lit(0))) | (F.col("segments") > F.coalesce("_s", F.lit(0)))
    due = F.col("_at").isNull() | (F.col("at") - F.col("_at") >= every) | (F.lit(force) & new)
    return j.where((F.col("frames") > 0) & due).select(latest.columns)


def run_live(frames: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, **options):
    """Start keeping frames; ``on_batch`` gets the newly kept ones of each micro-batch, exactly once if it writes by
    batch number. Progress and state are in ``checkpoint``: started again, the session goes on where it was."""
    return keep(frames, **options).writeStream.outputMode("append").foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(spark: SparkSession, root: str, checkpoint: str, process: Callable[[str, str], None], status: str):
    """Files as they appear under a folder; each is processed on its own, some at a time, and what came of it is a row in
    ``status`` (``path, modified, state, error``), failures included, so that one bad file doesn't stop the others."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root).select("path", F.col("modificationTime").alias("modified"))

    def one(r) -> tuple:
        try:
            process(r.path, str(r.modified))
            return r.path, r.modified, "ok", None
        except Exception as e:  # noqa: BLE001  recorded, not hidden
            return r.path, r.modified, "error", str(e)

    def each(batch: DataFrame, number: int) -> None:
        new = batch.collect()  # a listing of new files
        with ThreadPoolExecutor(AT_A_TIME) as pool:
            done = list(pool.map(one, new))
        if done:
            spark.createDataFrame(done, "path string, modified timestamp, state string, error string").write.mode("append").parquet(status)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
