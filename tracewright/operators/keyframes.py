"""Key frames out of sampled frames, and what changed between them.

Samples are ``(run_id, t, hash)`` with hashes in hex. What depends on earlier decisions is a grouped map per run; a run
is one recording, hours at most, so a group stays small however many runs there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.text import crop_wanted
from tracewright.operators.folds import fold_groups

# Bits, seconds and counts of the detectors, and the grids of the frame hash.
DISTANCE, SCENE_DISTANCE, MIN_GAP, MOST, FALLBACK, FEWEST_CHANGES, SCENE_CHANGE = 8, 6, 1.5, 240, 10.0, 3, 0.05
GRID, COLOUR_GRID, COLOUR_MARGIN, PIXEL_CHANGE, IGNORED = 24, 4, 8, 24, 0.002


class Keeper:
    """Keeps a frame that differs by more than ``distance`` bits from the last one kept and comes at least ``min_gap``
    seconds after it. The same state serves batches and streams."""

    def __init__(self, distance: int = DISTANCE, min_gap: float = MIN_GAP, last: tuple[str, float] | None = None, changed: int = 0, kept: int = 0):
        self.distance, self.min_gap, self.last, self.changed, self.kept = distance, min_gap, last, changed, kept

    def take(self, t: float, hash_: str) -> bool:
        if self.last and (int(hash_, 16) ^ int(self.last[0], 16)).bit_count() <= self.distance:
            return False
        self.changed += 1  # also when the gap says no
        if self.last and t - self.last[1] < self.min_gap:
            return False
        self.last, self.kept = (hash_, t), self.kept + 1
        return True


def keep_changed(samples: DataFrame, distance: int = DISTANCE, min_gap: float = MIN_GAP, fallback: float | None = None) -> DataFrame:
    """The samples kept, with ``frame``, their number in the run. With ``fallback``, a run whose samples changed fewer
    than three times gets one sample every so many seconds instead."""
    at, of = samples.columns.index("t"), samples.columns.index("hash")

    def fold(rows: list[tuple]) -> Iterable[tuple]:
        keeper = Keeper(distance, min_gap)
        kept = [r for r in rows if keeper.take(r[at], r[of])]
        if fallback and keeper.changed < FEWEST_CHANGES:
            kept, due = [], -np.inf
            for r in rows:
                if r[at] >= due:
                    kept.append(r)
                    due = r[at] + fallback
        return [(*r, i) for i, r in enumerate(kept)]

    return fold_groups(samples, ["run_id"], ["t"], fold, T.StructType([*samples.schema.fields, T.StructField("frame", T.IntegerType())]))


def survivors(hashes: Sequence[str], most: int) -> list[int]:
    """Places left when the frame that differs least from the one before it goes, again and again, until ``most`` are
    left; the one after it is then measured against its new neighbour. The earliest of equals goes; the first stays."""
    bits = [int(h, 16) for h in hashes]
    left = list(range(len(bits)))
    far = np.array([np.inf, *((bits[i] ^ bits[i - 1]).bit_count() for i in range(1, len(bits)))])
    while len(left) > max(most, 1):
        k = int(far.argmin())
        del left[k]
        far = np.delete(far, k)
        if k < len(left):
            far[k] = (bits[left[k]] ^ bits[left[k - 1]]).bit_count()
    return left


def thin(frames: DataFrame, most: int = MOST) -> DataFrame:
    """At most ``most`` frames a run, by ``survivors`` in the order of ``t``, numbered anew in ``frame``."""

    def run(rows):
        rows = rows.sort_values("t", kind="stable")
        out = rows.iloc[survivors(list(rows["hash"]), most)]
        return out.assign(frame=range(len(out)))

    base = frames.drop("frame")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", frame int"
    return base.groupBy("run_id").applyInPandas(lambda r: run(r), schema)


def keep_scenes(samples: DataFrame, threshold: float = SCENE_CHANGE, distance: int = SCENE_DISTANCE, min_gap: float = MIN_GAP, fallback: float | None = None) -> DataFrame:
    """By brightness: of samples with ``score``, how much of the brightness has changed since the one before (null for the
    first), those over ``threshold`` and the first of a run are scenes. Of three scenes or more, those too like or too
    close to the last one kept go; fewer are all kept, or with ``fallback`` give way to a sample every so many seconds."""
    w = Window.partitionBy("run_id").orderBy("t")
    found = samples.withColumn("_first", F.row_number().over(w) == 1).withColumn("_scene", F.col("_first") | (F.col("score") > threshold))
    found = found.withColumn("_n", F.sum(F.col("_scene").cast("int")).over(Window.partitionBy("run_id")))
    cols = samples.columns
    many = keep_changed(found.where("_scene").where(F.col("_n") >= FEWEST_CHANGES).select(*cols), distance, min_gap)
    few = found.where(F.col("_n") < FEWEST_CHANGES)
    if fallback is None:
        few = few.where("_scene").withColumn("frame", (F.row_number().over(w) - 1).cast("int")).select(*cols, "frame")
    else:
        # No distance keeps all: each sample is due a gap after the last one that was.
        few = keep_changed(few.select(*cols), -1, fallback)
    return many.unionByName(few)


def brightness_change(frames: DataFrame) -> DataFrame:
    """``run_id, index, score`` of frames with pixels: the mean change of brightness since the frame before, from 0 to 1."""

    def run(rows):
        rows = rows.sort_values("index")
        grey = [np.frombuffer(p, np.uint8).reshape(h, w, 3).astype(float) @ (0.299, 0.587, 0.114) for p, w, h in zip(rows["pixels"], rows["width"], rows["height"], strict=True)]
        scores = [None, *(float(np.abs(b - a).mean() / 255) if a.shape == b.shape else 1.0 for a, b in zip(grey, grey[1:]))]
        return rows[["run_id", "index"]].assign(score=scores[: len(rows)])

    return frames.groupBy("run_id").applyInPandas(run, "run_id string, index int, score double")


def sampled(samples: DataFrame, per_second: float) -> DataFrame:
    """The first sample of each stretch of ``1 / per_second`` seconds."""
    part = F.floor(F.col("t") * per_second + 1e-9)
    first = F.row_number().over(Window.partitionBy("run_id", "_part").orderBy("t"))
    return samples.withColumn("_part", part).withColumn("_n", first).where("_n = 1").drop("_part", "_n")


def extract(samples: DataFrame, distance: int = DISTANCE, min_gap: float = MIN_GAP, fallback: float = FALLBACK, most: int = MOST, detect: str = "hash") -> DataFrame:
    """Key frames by ``hash``, what the picture looks like, or by ``scene``, its brightness; at most ``most`` a run."""
    kept = keep_scenes(samples, min_gap=min_gap, fallback=fallback) if detect == "scene" else keep_changed(samples, distance, min_gap, fallback)
    return thin(kept, most)


def boxed(a: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """A picture shrunk to a grid of means; cells weigh the pixels that they cover."""
    def weights(size: int, cells: int) -> np.ndarray:
        edge = np.linspace(0, size, cells + 1)
        px = np.arange(size)
        w = np.clip(np.minimum(edge[1:, None], px + 1) - np.maximum(edge[:-1, None], px), 0, None)
        return w / w.sum(axis=1, keepdims=True)

    return np.einsum("rh,hw...,cw->rc...", weights(a.shape[0], rows), a.astype(float), weights(a.shape[1], cols))


def frame_hash(rgb: np.ndarray) -> str:
    """672 bits of a picture (height, width, 3) in hex: brightness rising from cell to cell on a 24 by 24 grid, and on a
    4 by 4 grid which colours are clearly above which."""
    grey = np.rint(boxed(rgb @ np.array([0.299, 0.587, 0.114]), GRID, GRID + 1))
    rising = (grey[:, :-1] < grey[:, 1:]).ravel()
    cells = np.rint(boxed(rgb, COLOUR_GRID, COLOUR_GRID)).reshape(-1, 3)
    hue = [x for c in cells for a, b in ((0, 1), (1, 2), (0, 2)) for x in (c[a] > c[b] + COLOUR_MARGIN, c[b] > c[a] + COLOUR_MARGIN)]
    return np.packbits(np.concatenate([rising, np.array(hue)])).tobytes().hex()


def layout_hash(rgb: np.ndarray) -> str:
    """64 bits: brightness rising from cell to cell on an 8 by 8 grid."""
    grey = np.rint(boxed(rgb @ np.array([0.299, 0.587, 0.114]), 8, 9))
    return np.packbits((grey[:, :-1] < grey[:, 1:]).ravel()).tobytes().hex()


def changed_box(before: np.ndarray, after: np.ndarray, threshold: int = PIXEL_CHANGE, ignored: float = IGNORED) -> tuple[int, int, int, int, float] | None:
    """x, y, w, h around the pixels that changed, and their share; None below the share that is noise. Pictures of
    different sizes differ everywhere."""
    h, w = after.shape[:2]
    if before.shape != after.shape:
        return 0, 0, w, h, 1.0
    moved = np.abs(before.astype(int) - after.astype(int)).max(axis=2) > threshold
    share = float(moved.mean())
    if share < ignored or not moved.any():
        return None
    ys, xs = np.flatnonzero(moved.any(axis=1)), np.flatnonzero(moved.any(axis=0))
    return int(xs[0]), int(ys[0]), int(xs[-1] - xs[0] + 1), int(ys[-1] - ys[0] + 1), round(share, 4)


def picture(raw: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(height, width, 3)


def with_hash(frames: DataFrame, layout: bool = False) -> DataFrame:
    """``frames`` (``pixels`` raw RGB, ``width``, ``height``) with ``hash``, one picture in memory at a time."""
    make = layout_hash if layout else frame_hash

    def run(batches: Iterable):
        for b in batches:
            yield b.assign(hash=[make(picture(p, w, h)) for p, w, h in zip(b["pixels"], b["width"], b["height"], strict=True)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema) + ", hash string"
    return frames.mapInPandas(run, schema)


def annotate(frames: DataFrame) -> DataFrame:
    """``frames`` with ``change_from_previous``, the box that changed since the frame before in the run."""
    w = Window.partitionBy("run_id").orderBy("index")
    pairs = frames.withColumn("_p", F.lag("pixels").over(w)).withColumn("_w", F.lag("width").over(w)).withColumn("_h", F.lag("height").over(w))

    def run(batches: Iterable):
        for b in batches:
            out = []
            for r in b.itertuples():
                box = changed_box(picture(r[b.columns.get_loc("_p") + 1], int(r[b.columns.get_loc("_w") + 1]), int(r[b.columns.get_loc("_h") + 1])), picture(r.pixels, r.width, r.height)) if r[b.columns.get_loc("_p") + 1] is not None else None
                out.append(dict(zip(("x", "y", "w", "h", "fraction"), box, strict=True)) if box else None)
            yield b.drop(columns=["_p", "_w", "_h"]).assign(change_from_previous=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema) + ", change_from_previous struct<x:int,y:int,w:int,h:int,fraction:double>"
    return pairs.mapInPandas(run, schema)


def enlarged(pixels: np.ndarray, width: int) -> np.ndarray:
    """A picture scaled to a width, by the nearest pixels."""
    h, w = pixels.shape[:2]
    height = max(1, round(h * width / w))
    return pixels[np.arange(height) * h // height][:, np.arange(width) * w // width]


def close_ups(annotated: DataFrame, pad: int = 24, least: int = 640, most: int = 1600) -> DataFrame:
    """``run_id, index, crop_width, crop_height, crop``: what changed, with a margin, of frames where that is real but
    well less than the whole, scaled up to ``least`` wide, and never wider than ``most``."""
    c = F.col("change_from_previous")
    wanted = annotated.where(c.isNotNull() & crop_wanted(c.w, c.h, c.fraction, F.col("width"), F.col("height")))
    rows = wanted.select("run_id", "index", "pixels", "width", "height", c.x.alias("x"), c.y.alias("y"), c.w.alias("w"), c.h.alias("h"))

    def run(batches: Iterable):
        import pandas as pd

        for b in batches:
            out = []
            for r in b.itertuples():
                img = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)
                part = img[max(0, r.y - pad) : r.y + r.h + pad, max(0, r.x - pad) : r.x + r.w + pad]
                width = min(max(part.shape[1], least), most)
                part = part if width == part.shape[1] else enlarged(part, width)
                out.append((r.run_id, b.loc[r.Index, "index"], part.shape[1], part.shape[0], part.tobytes()))
            yield pd.DataFrame(out, columns=["run_id", "index", "crop_width", "crop_height", "crop"])

    return rows.mapInPandas(run, "run_id string, index int, crop_width int, crop_height int, crop binary")


def screenshot_times(files: DataFrame, step: float = 10.0) -> DataFrame:
    """``files`` (``run_id, name``) with ``timestamp``: seconds or a date-time in the name (from the earliest one on);
    the others follow the last timed one in natural order, ``step`` seconds apart."""
    from tracewright.functions.text import natural_key

    # Fixed patterns: names that hold seconds, and names that hold a date and a time.
    seconds = r"(?i)^(?:shot|screenshot|t|time|sec|secs)?[ _-]?\d+(?:\.\d+)?$"
    stamp = r"(?<!\d)(\d{4})-(\d{2})-(\d{2})[T _]+(?:at[ _]+)?(\d{2})[-:.]?(\d{2})[-:.]?(\d{2})(?:[.,](\d{1,6}))?(?:[ _]?([AaPp][Mm]))?"
    stem = F.regexp_replace("name", r"\.[A-Za-z]{2,4}$", "")
    part = lambda i: F.regexp_extract(stem, stamp, i)
    n = lambda i: part(i).try_cast("int")
    half = F.lower(part(8))
    hour = F.when(half == "", n(4)).otherwise(n(4) % 12 + F.when(half == "pm", 12).otherwise(0))
    micros = F.rpad(part(7), 6, "0").try_cast("int")
    when = F.try_make_timestamp(n(1), n(2), n(3), hour, n(5), n(6) + F.coalesce(micros, F.lit(0)) / F.lit(1e6), F.lit("UTC"))
    df = files.withColumn("_s", F.when(stem.rlike(seconds), F.regexp_extract(stem, r"(\d+(?:\.\d+)?)$", 1).cast("double")))
    df = df.withColumn("_at", F.when(F.col("_s").isNull(), F.unix_micros(when) / 1e6))
    whole = Window.partitionBy("run_id")
    df = df.withColumn("_t", F.coalesce("_s", F.col("_at") - F.min("_at").over(whole)))
    order = Window.partitionBy("run_id", F.col("_t").isNull()).orderBy(natural_key(F.col("name")))
    place = F.row_number().over(order)
    last = F.max("_t").over(whole)
    rest = F.when(last.isNull(), (place - 1) * step).otherwise(last + place * step)
    return df.withColumn("timestamp", F.coalesce("_t", rest).cast("double")).drop("_s", "_at", "_t")


def spread_notes(notes: DataFrame, frames: DataFrame) -> DataFrame:
    """Untimed notes ``(run_id, pos, text)`` as segments over frames with ``start`` and ``end``: note i of m goes to
    frame i * n // m of n, and notes of one frame share its time in equal parts."""
    w = Window.partitionBy("run_id")
    placed = notes.withColumn("_m", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy("pos")) - 1)
    numbered = frames.select("run_id", "start", "end", (F.row_number().over(w.orderBy("start", "index")) - 1).alias("_f"), F.count("*").over(w).alias("_n"))
    counts = numbered.select("run_id", "_n").distinct()
    placed = placed.join(counts, "run_id").withColumn("_f", F.floor(F.col("_i") * F.col("_n") / F.col("_m")))
    joined = placed.join(numbered.drop("_n"), ["run_id", "_f"])
    share = Window.partitionBy("run_id", "_f")
    span, j = (F.col("end") - F.col("start")) / F.count("*").over(share), F.row_number().over(share.orderBy("_i")) - 1
    from_ = F.col("start") + j * span
    return joined.select("run_id", "pos", F.bround(from_, 3).alias("start"), F.bround(from_ + span, 3).alias("end"), "text")
