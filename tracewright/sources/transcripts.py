"""Transcript files of any of four kinds as one table of segments.

``run_id`` is the file's path; rows keep the file's order in ``pos``. Everything but JSON of unknown shape is parsed by
expressions: a file is one row, cut into blocks or lines.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.text import parse_time, squeezed
from tracewright.schema import WORDS

# Fixed patterns and names: timing lines, tags, lines led by a time, and the keys that tools use.
TIMING = r"(?m)^\s*([\d:.,]+)[ \t]*-->[ \t]*([\d:.,]+)[^\n]*\n?"
VOICE, TAG = r"<v(?:\.[^\s>]*)?\s+([^>]*)>", r"<[^>]+>"
TIMED_LINE = r"^\s*\[?\s*((?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d+)?)\s*\]?\s*(?:[-–:]\s*)?(.*)$"
SUBRIP = r"(?m)^\s*\d+\s*\r?\n\s*[\d:.,]+\s*-->"
LISTS = "segments entries results transcript items data captions utterances sentences".split()
START = "start startTime start_time startOffset start_offset offset begin from timestamp ts time".split()
END = "end endTime end_time endOffset end_offset to stop finish".split()
DURATION = "duration dur length".split()
TEXT = "text content transcript caption value sentence utterance".split()
SPEAKER = "speaker speakerName speaker_name speakerLabel speaker_label name user author".split()
COLUMNS = ["run_id", "pos", "start", "end", "text", "speaker", "words"]


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``run_id, value``: whole files, a byte order mark at their head removed."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("run_id"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    return rows


def kind(path: Column, text: Column) -> Column:
    """``vtt``, ``json``, ``srt`` or ``plain``, by suffix and then by content."""
    low, head = F.lower(path), F.ltrim(F.regexp_replace(text, r"^\s+", ""))
    return (
        F.when(low.endswith(".vtt") | head.startswith("WEBVTT"), "vtt")
        .when(low.endswith(".json") | head.rlike(r"^[\[{]"), "json")
        .when(low.endswith(".srt") | text.rlike(SUBRIP), "srt")
        .otherwise("plain")
    )


def _none() -> Column:
    return F.array().cast(WORDS)


def cues(texts: DataFrame, headers: bool) -> DataFrame:
    """Blocks between blank lines that hold a timing line; with ``headers`` those of a WebVTT file's own are left out. A
    time that can't be read is an error."""
    blocks = F.split(F.regexp_replace("value", "\r\n", "\n"), r"\n(?:[ \t\f\x0B]*\n)+")
    rows = texts.select("run_id", F.posexplode(blocks).alias("pos", "block")).withColumn("block", F.regexp_replace("block", r"^\s+|\s+$", ""))
    if headers:
        rows = rows.where(~F.col("block").rlike("^(?:WEBVTT|NOTE|STYLE|REGION)"))
    rows = rows.where(F.col("block").rlike(TIMING))
    raw = F.regexp_replace(F.regexp_extract("block", TIMING + r"((?s).*)\z", 3), "\n", " ")
    at = lambda i: F.coalesce(parse_time(F.regexp_extract("block", TIMING, i)), F.raise_error(F.concat(F.lit("not a time: "), F.left("block", F.lit(60)))).cast("double"))
    who = F.trim(F.regexp_extract(raw, VOICE, 1))
    return rows.select("run_id", "pos", at(1).alias("start"), at(2).alias("end"), squeezed(F.regexp_replace(raw, TAG, "")).alias("text"), F.when(who != "", who).alias("speaker"), _none().alias("words"))


def timed_lines(texts: DataFrame) -> DataFrame:
    """Lines led by a time; each ends where the next starts, the last after 0.4 seconds a word, one second at least."""
    rows = texts.select("run_id", F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), "\n")).alias("pos", "line")).where(F.col("line").rlike(TIMED_LINE))
    rows = rows.select("run_id", "pos", parse_time(F.regexp_extract("line", TIMED_LINE, 1)).alias("start"), F.trim(F.regexp_extract("line", TIMED_LINE, 2)).alias("text")).where("start is not null")
    nxt = F.lead("start").over(Window.partitionBy("run_id").orderBy("pos"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    end = F.when(nxt.isNotNull(), F.greatest("start", nxt)).otherwise(F.col("start") + F.greatest(F.lit(1.0), words * 0.4))
    return rows.select("run_id", "pos", "start", end.alias("end"), "text", F.lit(None).cast("string").alias("speaker"), _none().alias("words"))


def seconds(value: Any) -> float | None:
    """Numbers are seconds; text is read like any time; all else is none."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return float(value)
    import re

    text = str(value).strip().strip("[]").strip()
    if m := re.fullmatch(r"(?i)PT(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?", text):
        return sum(float(g or 0) * u for g, u in zip(m.groups(), (3600, 60, 1), strict=True))
    if not re.fullmatch(r"(?:\d{1,2}:){0,2}\d{1,2}(?:[.,]\d+)?", text):
        return None
    total = 0.0
    for part in text.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def entries(data: Any) -> list[dict]:
    """The list of objects in an export of unknown shape: itself, under a usual name, nested there, or anywhere."""
    if isinstance(data, list):
        return [x for x in data if isinstance(x, dict)]
    if not isinstance(data, dict):
        return []
    named = [data[k] for k in LISTS if k in data]
    for value in named:
        if isinstance(value, dict) and (found := entries(value)):
            return found
        if isinstance(value, list) and value and isinstance(value[0], dict):
            return entries(value)
    return next((entries(v) for v in data.values() if isinstance(v, list) and v and isinstance(v[0], dict)), [])


def _pick(item: dict, names: list[str]) -> Any:
    return next((item[n] for n in names if item.get(n) not in (None, "")), None)


def json_segments(text: str | None) -> list[dict]:
    out = []
    for item in entries(json.loads(text or "null")):
        body, start = _pick(item, TEXT), seconds(_pick(item, START))
        if not isinstance(body, str) or not body.strip() or start is None:
            continue
        end, length = _pick(item, END), seconds(_pick(item, DURATION))
        stop = seconds(end) if end is not None else None if length is None else start + length
        who = _pick(item, SPEAKER)
        who = _pick(who, ["name", "displayName", "label"]) if isinstance(who, dict) else who
        out.append({"start": start, "end": max(start, stop if stop is not None else start), "text": body.strip(), "speaker": None if who is None else str(who).strip() or None})
    return out


def exports(texts: DataFrame) -> DataFrame:
    item = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("speaker", T.StringType())])
    parsed = F.pandas_udf(lambda s: s.map(json_segments), T.ArrayType(item))
    rows = texts.select("run_id", F.posexplode(parsed(F.col("value"))).alias("pos", "s"))
    return rows.select("run_id", "pos", "s.start", "s.end", "s.text", "s.speaker", _none().alias("words"))


def parse(texts: DataFrame) -> DataFrame:
    """Segments of ``run_id, value`` rows, each by its kind."""
    marked = texts.withColumn("kind", kind(F.col("run_id"), F.col("value")))
    of = lambda k: marked.where(F.col("kind") == k).select("run_id", "value")
    out = cues(of("vtt"), headers=True)
    for part in (cues(of("srt"), headers=False), exports(of("json")), timed_lines(of("plain"))):
        out = out.unionByName(part)
    return out.withColumn("pos", F.row_number().over(Window.partitionBy("run_id").orderBy("pos")) - 1).select(COLUMNS)


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse(files(spark, path))


def split_notes(texts: DataFrame) -> DataFrame:
    """``run_id, pos, text``: untimed notes as paragraphs, or bullets where all lines of one are; a heading goes in
    front of the note after it."""
    marker, head = r"^\s*(?:[-*+•]|\d+[.)])\s+", r"^\s*#{1,6}\s+"
    rows = texts.select("run_id", F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), r"\n\s*\n")).alias("p", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), F.trim), lambda s: s != "")
    rows = rows.withColumn("lines", lines).where(F.size("lines") > 0)
    heading = F.forall("lines", lambda s: s.rlike(head))
    bullets = F.forall("lines", lambda s: s.rlike(marker))
    bare = F.array_join(F.transform("lines", lambda s: F.regexp_replace(s, head, "")), " ")
    rows = rows.withColumn("heading", F.when(heading, bare)).withColumn("pieces", F.when(bullets, F.transform("lines", lambda s: F.regexp_replace(s, marker, ""))).otherwise(F.array(bare)))
    w = Window.partitionBy("run_id").orderBy("p")
    rows = rows.withColumn("before", F.lag("heading").over(w)).where("heading is null")
    first = F.concat(F.col("before"), F.lit(": "), F.element_at("pieces", 1))
    rows = rows.withColumn("pieces", F.when(F.col("before").isNotNull(), F.concat(F.array(first), F.slice("pieces", F.lit(2), F.greatest(F.size("pieces") - 1, F.lit(0))))).otherwise(F.col("pieces")))
    notes = rows.select("run_id", "p", F.posexplode("pieces").alias("i", "text"))
    return notes.select("run_id", (F.row_number().over(Window.partitionBy("run_id").orderBy("p", "i")) - 1).alias("pos"), "text")
