"""The commands as functions: what one would type for a run, in terms of tables and folders."""

from __future__ import annotations

import difflib
import os
import tomllib
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import schema
from tracewright.operators import compare as comparing
from tracewright.operators import boxes, chunks, feedback, keyframes, merge as merging, personal, score as scoring
from tracewright.operators.gaps import Tables
from tracewright.plans.model import Caller, FakeCaller
from tracewright.plans.session import Session, plan, resolve as resolve_session, run as run_session, within_budget
from tracewright.sinks import pages, tickets
from tracewright.sources import documents, transcripts
from tracewright.streaming import live

#: Setting -> (type, default, least, choices).
SETTINGS: dict[str, tuple[type, Any, float | None, tuple[str, ...] | None]] = {
    "frames_per_call": (int, 8, 1, None), "max_frames": (int, 240, 1, None), "hash_distance": (int, 8, 0, None), "sample_fps": (float, 1.0, 0.01, None),
    "min_gap": (float, 1.5, 0.0, None), "detect": (str, "hash", None, ("hash", "scene")), "every_seconds": (float, 300.0, 1.0, None), "max_cost": (float, None, 0.0, None),
    "redact_style": (str, "box", None, ("box", "blur")),
}


def settings(path: str | None = None, **given: Any) -> dict[str, Any]:
    """Arguments over the settings file over defaults. Unknown names are errors with a suggestion, and so are names that
    look like secrets: those don't belong in a file."""
    found: dict[str, Any] = {}
    if path and os.path.exists(path):
        found = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    out = {k: v[1] for k, v in SETTINGS.items()}
    for name, value in {**found, **{k: v for k, v in given.items() if v is not None}}.items():
        if any(w in name.lower() for w in ("key", "token", "secret", "password")):
            raise ValueError(f"{name}: secrets belong in the environment")
        if name not in SETTINGS:
            near = difflib.get_close_matches(name, SETTINGS, 1)
            raise ValueError(f"unknown setting {name}" + (f"; did you mean {near[0]}?" if near else ""))
        kind, _, least, choices = SETTINGS[name]
        if isinstance(value, bool) or not isinstance(value, (int, float) if kind is float else kind):
            raise ValueError(f"{name} must be of type {kind.__name__}")
        if choices and value not in choices:
            raise ValueError(f"{name} must be one of {', '.join(choices)}")
        if least is not None and value < least:
            raise ValueError(f"{name} must be at least {least}")
        out[name] = value
    return out


def key_frames(frames: DataFrame, options: dict[str, Any]) -> DataFrame:
    """Key frames as they are; out of samples, those that the settings say."""
    if "t" not in frames.columns:
        return frames
    kept = keyframes.extract(keyframes.sampled(frames, options["sample_fps"]), options["hash_distance"], options["min_gap"], most=options["max_frames"], detect=options["detect"])
    return kept.select("run_id", F.col("frame").alias("index"), F.col("t").alias("timestamp"))


def run(spark: SparkSession, frames: DataFrame, transcript_path: str, run_id: str, out_dir: str, caller: Caller | None = None, prices: DataFrame | None = None, **given: Any) -> Session:
    """A transcript file and frames to an analysis and its reports in ``out_dir``. Frames are key frames ``(run_id, index,
    timestamp)``, or samples ``(run_id, t, hash)``, with ``score`` for the scene detector, out of which key frames are
    picked as the settings say. With ``max_cost``, ``prices`` are needed, and nothing is read that would cost more."""
    options = settings(given.pop("settings_file", None), **given)
    segments = transcripts.read(spark, transcript_path).withColumn("run_id", F.lit(run_id))
    if options["max_cost"] is not None and prices is None:
        raise ValueError("max_cost needs prices")
    frames = key_frames(frames, options)
    frames.write.mode("overwrite").parquet(f"{out_dir}/keyframes")  # picked once; the plans from here on read them often
    frames = spark.read.parquet(f"{out_dir}/keyframes")
    if options["max_cost"] is not None:
        m, _ = plan(frames, segments, size=options["frames_per_call"])
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        m = m.select("run_id", "start", chunks.spoken(F.col("segments")).alias("text"), *(none(c, "int") for c in ("width", "height", "crop_width", "crop_height")), none("ocr", "string"))
        within_budget(m, chunks.transcript(segments), prices, options["max_cost"])
    made = run_session(frames, segments, caller or FakeCaller(), size=options["frames_per_call"], store=f"{out_dir}/readings")
    export(made.tables, run_id, out_dir, segments=segments)
    return made


def rounds(arrivals: DataFrame, **given: Any) -> DataFrame:
    """When a live recording is due to be read again, by the setting ``every_seconds``."""
    return live.rounds(arrivals, settings(given.pop("settings_file", None), **given)["every_seconds"])


def redact(frames: DataFrame, located: DataFrame, **given: Any) -> DataFrame:
    """Frames with what was found painted over, in the style that the settings name."""
    return boxes.redact(frames, located, settings(given.pop("settings_file", None), **given)["redact_style"])


def export(t: Tables, run_id: str, out_dir: str, keyframes: DataFrame | None = None, **more: DataFrame) -> dict[str, Path]:
    own = pages.of_run(t, run_id)
    out = pages.export(own, run_id, out_dir, **more)
    if keyframes is not None:
        tickets.write_csv(tickets.jira(own, keyframes), f"{out_dir}/jira_import")
        tickets.write_csv(tickets.azure(own, keyframes), f"{out_dir}/azure_devops_import")
    return out


def score(t: Tables, expected: DataFrame, runs: DataFrame, least: float = 0.7) -> tuple[DataFrame, bool]:
    """Scores by category, and whether every run's mean recall is at least ``least``."""
    s = scoring.score(t, expected, runs)
    worst = scoring.overall(s).agg(F.min("overall_recall")).first()[0]
    return s, (worst or 0.0) >= least - 1e-9


def merge(spark: SparkSession, paths: list[str], runs: DataFrame) -> Tables:
    """Several stored analyses as one; ``runs`` says their order, frames and durations."""
    return merging.merge(schema.entities(documents.read_analyses(spark, paths)), runs)


def compare(a: Tables, b: Tables) -> DataFrame:
    return comparing.compare(comparing.items(a, "a").unionByName(comparing.items(b, "b")))


def answers(t: Tables, given: DataFrame) -> tuple[Tables, DataFrame]:
    """Questions with the answers put in, and the ids that no question has."""
    q = feedback.upsert(t["questions"], given, ["id"], ["answer", "status"])
    return dict(t) | {"questions": q.drop("changed")}, feedback.unknown(t["questions"], given, ["id"])


def resolve(t: Tables, caller: Caller, out_dir: str, done: DataFrame | None = None) -> tuple[Tables, DataFrame]:
    """Answered questions worked in, each once: pass the ids that come back as ``done`` the next time."""
    return resolve_session(t, caller, done, f"{out_dir}/resolved")


def scrub(t: Tables, pairs: list[tuple[str, str]]) -> Tables:
    """Every text column of every table with raw values replaced by their masks, longest first."""
    if not pairs:
        return t
    lits = F.array(*(F.struct(F.lit(r).alias("raw"), F.lit(m).alias("masked")) for r, m in pairs))
    out = {}
    for name, rows in t.items():
        texts = [c for c, k in rows.dtypes if k == "string" and c not in ("run_id", "id") and not c.endswith("_id")]
        out[name] = rows.withColumns({c: personal.scrub(F.col(c), lits) for c in texts})
    return out
