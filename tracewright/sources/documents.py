"""Stored documents: recordings, analyses, frame texts, readings, replies; and what is pending in a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import schema


def _json(spark: SparkSession, path: str | list[str], ddl: str) -> DataFrame:
    body = ddl.replace("run_id string, ", "", 1)
    rows = spark.read.schema(body).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.input_file_name().alias("run_id"), "*")


def read_recordings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _json(spark, path, schema.RECORDING)


def read_analyses(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A document that doesn't fit its schema, or holds a value outside a closed set, is an error."""
    rows = _json(spark, path, schema.ANALYSIS)
    for (name, field), allowed in schema.CHOICES.items():
        fine = F.forall(F.coalesce(name, F.array().cast(rows.schema[name].dataType)), lambda x: x[field].isNull() | x[field].isin(*allowed))
        checked = F.when(fine, F.col("title")).otherwise(F.raise_error(F.lit(f"{name}.{field} must be one of {', '.join(allowed)}")))
        rows = rows.withColumn("title", checked)
    return rows


def ocr_cache(texts: DataFrame, tolerant: bool = False) -> DataFrame:
    """``run_id, index, text`` from cached JSON ``{"3": "..."}``. A broken cache is an error, or, ``tolerant``, empty."""
    parsed = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE" if tolerant else "FAILFAST"})
    rows = texts.select("run_id", F.explode(parsed).alias("k", "text"))
    return rows.select("run_id", F.col("k").try_cast("int").alias("index"), "text").where("index is not null")


def reply(raw: Column, ddl: str) -> Column:
    """The object in a model's reply, from its first brace to its last, by a schema; null where there is none."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.when(body != "", F.from_json(body, ddl))


def readings(spark: SparkSession, path: str, reading: str) -> DataFrame:
    """``key, reading`` of stored chunk readings; files of another form give none."""
    rows = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", f"array<struct<key:string,reading:{reading}>>", {"mode": "PERMISSIVE"})
    return rows.select(F.explode(parsed).alias("x")).select("x.*").where("key is not null")


def request_state(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """``run_id, chunk, state``: which requests have been answered."""
    done = answers.select("run_id", "chunk").distinct().withColumn("_done", F.lit(True))
    joined = requests.select("run_id", "chunk").distinct().join(done, ["run_id", "chunk"], "left")
    return joined.select("run_id", "chunk", F.when(F.col("_done"), "answered").otherwise("waiting").alias("state"))


# What counts as a video, a screenshot and a transcript, in order of preference.
VIDEOS = [".mp4", ".mov", ".mkv", ".webm"]
PICTURES = [".png", ".jpg", ".jpeg"]
TRANSCRIPTS = [".vtt", ".srt", ".json", ".txt", ".md"]


def watch_items(files: DataFrame, root: str) -> DataFrame:
    """``stem, kind, modified, transcript`` out of a listing ``(path, modificationTime)``: videos in the folder and
    subfolders with pictures, each with the transcript of its name; names that start with a dot are left out."""
    tail = F.replace("path", F.lit(root.rstrip("/") + "/"), F.lit(""))
    parts = F.split(tail, "/")
    name, suffix = F.element_at(parts, -1), F.lower(F.regexp_extract(tail, r"(\.[^./]+)$", 1))
    rows = files.select("path", "modificationTime", parts.alias("parts"), name.alias("name"), suffix.alias("suffix")).where(~F.element_at("parts", 1).startswith("."))
    rows = rows.withColumn("stem", F.when(F.size("parts") == 1, F.regexp_replace("name", r"\.[^.]+$", "")).otherwise(F.element_at("parts", 1)))
    top = rows.where(F.size("parts") == 1)
    videos = top.where(F.col("suffix").isin(*VIDEOS)).groupBy("stem").agg(F.lit("video").alias("kind"), F.max("modificationTime").alias("modified"))
    folders = rows.where(F.size("parts") == 2).groupBy("stem").agg(F.max(F.col("suffix").isin(*PICTURES)).alias("any"), F.max("modificationTime").alias("modified"))
    items = videos.unionByName(folders.where("any").select("stem", F.lit("screenshots").alias("kind"), "modified"))
    rank = F.array_position(F.array(*map(F.lit, TRANSCRIPTS)), F.col("suffix"))
    notes = top.where(F.col("suffix").isin(*TRANSCRIPTS)).groupBy("stem").agg(F.min_by("path", rank).alias("transcript"))
    return items.join(notes, "stem", "left")


def pending(items: DataFrame, outputs: DataFrame) -> DataFrame:
    """Items without an output, or touched since (``reprocess``)."""
    done = outputs.select("stem", F.col("modified").alias("_done"))
    joined = items.join(done, "stem", "left").withColumn("reprocess", F.col("_done").isNotNull())
    return joined.where("_done is null or modified > _done").drop("_done")
