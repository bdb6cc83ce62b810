"""Answers coming back: reading them, upserting them, and working what follows from them into an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import answer_status, trailing_number
from tracewright.operators.gaps import Tables
from tracewright.operators.merge import NUMBERS


def sheet_answers(rows: DataFrame) -> DataFrame:
    """``id, answer, status`` from a sheet whose columns are found by name in any case; rows with neither are left out.
    A status is taken as written: an answer to an open question leaves it open."""
    names = {c.strip().lower(): c for c in rows.columns}
    col = lambda n: F.when(F.trim(F.col(f"`{names[n]}`").cast("string")) != "", F.trim(F.col(f"`{names[n]}`").cast("string"))) if n in names else F.lit(None).cast("string")
    out = rows.select(col("id").alias("id"), col("answer").alias("answer"), answer_status(col("status")).alias("status"))
    status = F.when(F.col("status") == "open", None).when(F.col("status").isNull() & F.col("answer").isNotNull(), "answered").otherwise(F.col("status"))
    return out.where("id is not null").withColumn("status", status).where("answer is not null or status is not null")


def exported_answers(texts: DataFrame, text: str = "value") -> DataFrame:
    """``id, answer, status`` from exported JSON ``{id: {answer, status}}``: here an answer closes an open question."""
    entries = F.explode(F.from_json(F.col(text), "map<string,struct<answer:string,status:string>>"))
    out = texts.select(entries.alias("id", "x")).select("id", F.when(F.trim("x.answer") != "", F.trim("x.answer")).alias("answer"), answer_status(F.col("x.status")).alias("status"))
    status = F.when(F.col("answer").isNotNull() & (F.col("status").isNull() | (F.col("status") == "open")), "answered").when(F.col("status") == "open", None).otherwise(F.col("status"))
    return out.withColumn("status", status).where("answer is not null or status is not null")


def upsert(rows: DataFrame, patch: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` from ``patch`` where it has a value, and ``changed``."""
    p = patch.select(*key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = rows.join(p, key, "left")
    new = {c: F.coalesce(f"_new_{c}", c) for c in columns}
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~new[c].eqNullSafe(F.col(c))
    joined = joined.withColumn("changed", changed)
    return joined.withColumns(new).select(*rows.columns, "changed")


def unknown(rows: DataFrame, patch: DataFrame, key: list[str]) -> DataFrame:
    return patch.join(rows.select(*key).distinct(), key, "left_anti")


def answered(questions: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Questions with an answer that hasn't been worked in yet."""
    rows = questions.where("status = 'answered' and trim(answer) <> ''")
    return rows if done is None else rows.join(done.select("run_id", "id").distinct(), ["run_id", "id"], "left_anti")


def next_numbers(rows: DataFrame) -> DataFrame:
    """``run_id, next``: one above the largest number that an id ends with."""
    return rows.groupBy("run_id").agg((F.coalesce(F.max(trailing_number(F.col("id"))), F.lit(0)) + 1).alias("next"))


def _appended(rows: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """``new`` after ``rows``, with fresh ids above the largest and ``old_id`` kept for references."""
    letters, digits = NUMBERS[name]
    w = Window.partitionBy("run_id").orderBy("pos")
    top = rows.groupBy("run_id").agg(F.max("pos").alias("_top"))
    n = F.row_number().over(w) - 1 + F.coalesce("next", F.lit(1))
    out = new.join(next_numbers(rows), "run_id", "left").join(top, "run_id", "left").withColumn("old_id", F.col("id")).withColumn("_n", n.cast("string"))
    out = out.withColumn("id", F.concat(F.lit(letters), F.lpad("_n", F.greatest(F.lit(digits), F.length("_n")), F.lit("0"))))
    return out.withColumn("pos", F.row_number().over(w) + F.coalesce("_top", F.lit(-1))).drop("_n", "_top", "next")


def merge_delta(t: Tables, requirements: DataFrame, updates: DataFrame, criteria: DataFrame, follow_ups: DataFrame) -> Tables:
    """What the answers gave: new requirements and follow-up questions get fresh ids; ``updates`` (``run_id, id,
    statement, note``) overwrite statements and leave a note in the rationale; criteria of no requirement are dropped,
    screens that don't exist cleared, and follow-ups start open without an answer."""
    t = dict(t)
    screens = t["screens"].select("run_id", F.col("id").alias("screen_id")).distinct().withColumn("_ok", F.lit(True))
    cleared = lambda df: df.join(screens, ["run_id", "screen_id"], "left").withColumn("screen_id", F.when(F.col("_ok"), F.col("screen_id"))).drop("_ok")
    old = t["requirements"]
    u = updates.select("run_id", "id", F.col("statement").alias("_s"), F.col("note").alias("_note"))
    old = old.join(u, ["run_id", "id"], "left").withColumn("statement", F.coalesce("_s", "statement"))
    rationale = F.when(F.col("_note") != "", F.concat_ws(" ", F.when(F.col("rationale") != "", F.col("rationale")), F.col("_note"))).otherwise(F.col("rationale"))
    old = old.withColumn("rationale", rationale).select(t["requirements"].columns)
    new = _appended(t["requirements"], cleared(requirements), "requirements")
    t["requirements"] = old.unionByName(new.select(old.columns))
    names = new.select("run_id", F.col("old_id").alias("requirement_id"), F.col("id").alias("_to"))
    known = old.select("run_id", F.col("id").alias("requirement_id")).withColumn("_to", F.col("requirement_id")).join(names.select("run_id", "requirement_id"), ["run_id", "requirement_id"], "left_anti")
    owned = criteria.join(names.unionByName(known), ["run_id", "requirement_id"]).withColumn("requirement_id", F.col("_to")).drop("_to")
    t["criteria"] = t["criteria"].unionByName(_appended(t["criteria"], owned, "criteria").select(t["criteria"].columns))
    asked = _appended(t["questions"], cleared(follow_ups), "questions")
    asked = asked.withColumn("answer", F.lit(None).cast("string")).withColumn("status", F.lit("open"))
    t["questions"] = t["questions"].unionByName(asked.select(t["questions"].columns))
    return t


def ask_first(questions: DataFrame) -> DataFrame:
    """Questions by how many requirements they block, then by id as text, with ``rank``."""
    blocked = F.size(F.coalesce("blocks_requirement_ids", F.array().cast("array<string>")))
    return questions.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(blocked.desc(), "id")))
