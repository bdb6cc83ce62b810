"""A whole run as a plan: transcript and frames to moments, chunks, readings, an analysis; and what is kept of each
step, so that a later round reads only what has changed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import schema
from tracewright.operators import align, chunks, cost, feedback, keyframes, merge
from tracewright.operators.gaps import Tables
from tracewright.plans.model import Caller, read_in_halves

READING = "struct<" + ",".join(f"{k}:array<struct<{v}>>" for k, v in schema.ENTITIES.items()) + f",usage:array<{schema.USAGE}>>"


def known_block(seen: dict[str, dict]) -> str:
    """The screens that earlier chunks have shown, so that their ids stay the same."""
    if not seen:
        return "Screens identified so far: none yet. Start numbering at S01."
    return "\n".join(["Screens identified so far (reuse these ids when the screen reappears):", *(f"- {s['id']} {s['name']}: {s['purpose']}" for s in seen.values())])


def read_chunks(requests: DataFrame, caller: Caller, prior: DataFrame | None = None) -> DataFrame:
    """``run_id, chunk, key, reading`` (JSON): each chunk in turn, knowing the screens of those before. Chunks whose key
    ``prior`` has keep their reading and cost nothing. Runs are read independently of each other."""
    if prior is not None:
        requests = requests.join(prior.groupBy("key").agg(F.min("reading").alias("prior")), "key", "left")
    else:
        requests = requests.withColumn("prior", F.lit(None).cast("string"))

    def run(rows):
        import pandas as pd

        seen: dict[str, dict] = {}
        out = []
        for r in rows.sort_values("chunk").itertuples():
            if isinstance(r.prior, str):
                reading = json.loads(r.prior)
            else:
                parts = list(zip((int(f) for f in r.frames), r.parts, strict=True))
                replies = read_in_halves(caller, known_block(seen), parts)
                reading = {name: [x for reply in replies for x in reply.get(name, [])] for name in schema.ENTITIES}
                reading["usage"] = [reply["usage"] for reply in replies if reply.get("usage")]
            for s in reading.get("screens", []):
                seen.setdefault(s["id"], s)
            out.append((r.run_id, r.chunk, r.key, json.dumps(reading)))
        return pd.DataFrame(out, columns=["run_id", "chunk", "key", "reading"])

    return requests.groupBy("run_id").applyInPandas(run, "run_id string, chunk int, key string, reading string")


def consolidate(readings: DataFrame) -> Tables:
    """One analysis a run out of its readings: entities in the order of chunks, screens of an id once, folded by name
    and statement, and numbered anew."""
    parsed = readings.select("run_id", "chunk", F.from_json("reading", READING).alias("r"))
    t: Tables = {}
    for name in schema.ENTITIES:
        rows = parsed.select("run_id", "chunk", F.posexplode(f"r.{name}").alias("i", "x")).select("run_id", (F.col("chunk") * 100_000 + F.col("i")).alias("pos"), "x.*")
        if name == "screens":
            rows = chunks.first_seen(rows, "id", order=("pos",))
        t["criteria" if name == "acceptance_criteria" else name] = rows
    t["actors"] = t["journey"].where("actor <> ''").groupBy("run_id", "actor").agg(F.min("pos").alias("pos")).select("run_id", "pos", "actor")
    return merge.renumber(merge.fold_entities(t))


@dataclass
class Session:
    """What one pass made; ``readings`` is to be stored for the next."""

    moments: DataFrame
    requests: DataFrame
    readings: DataFrame
    tables: Tables = field(repr=False)


def plan(frames: DataFrame, segments: DataFrame, durations: DataFrame | None = None, ocr: DataFrame | None = None, size: int = chunks.FRAMES_PER_CALL) -> tuple[DataFrame, DataFrame]:
    """Moments and requests of the runs."""
    m = chunks.numbered(align.moments(frames, segments, durations), size)
    return m, chunks.requests(m, ocr).join(chunks.keys(m), ["run_id", "chunk"])


def run(frames: DataFrame, segments: DataFrame, caller: Caller, durations: DataFrame | None = None, ocr: DataFrame | None = None, prior: DataFrame | None = None, size: int = chunks.FRAMES_PER_CALL, store: str | None = None) -> Session:
    """Frames and speech to an analysis. With ``store`` the readings are written there before anything uses them, so
    that the model is called once; without, they are checkpointed in the session's shared folder. One of the two has to
    be there: a reading that is lost would be paid for again and might turn out otherwise."""
    m, asked = plan(frames, segments, durations, ocr, size)
    readings = read_chunks(asked, caller, prior)
    if store:
        readings.write.mode("overwrite").parquet(store)
        readings = readings.sparkSession.read.parquet(store)
    elif readings.sparkSession.conf.get("spark.checkpoint.dir", None):
        readings = readings.checkpoint()
    else:
        raise ValueError("give a folder for the readings, or set spark.checkpoint.dir")
    return Session(m, asked, readings, consolidate(readings))


def from_samples(samples: DataFrame, segments: DataFrame, caller: Caller, picking: dict | None = None, **options) -> Session:
    """As ``run``, with key frames picked out of sampled frames first; ``picking`` is for ``keyframes.extract``."""
    kept = keyframes.extract(samples, **(picking or {}))
    return run(kept.select("run_id", F.col("frame").alias("index"), F.col("t").alias("timestamp")), segments, caller, **options)


class OverBudget(Exception):
    pass


def within_budget(moments: DataFrame, transcripts: DataFrame, prices: DataFrame, most: float, read_prompt: int = 2000, merge_prompt: int = 1500) -> DataFrame:
    """Costs per run and price; an error if the cheapest price puts all runs together above ``most``."""
    priced = cost.priced(cost.tokens(moments, transcripts, read_prompt, merge_prompt), prices)
    least = priced.groupBy("model").agg(F.sum("total_cost").alias("c")).agg(F.min("c")).first()[0] or 0.0
    if least > most:
        raise OverBudget(f"reading would cost {least:.2f}, more than {most:.2f}")
    return priced


def write_requests(requests: DataFrame, path: str, answers: DataFrame | None = None) -> None:
    """Requests that nobody has answered yet as JSON files, for answering by hand or elsewhere."""
    open_ = requests if answers is None else requests.join(answers.select("run_id", "chunk").distinct(), ["run_id", "chunk"], "left_anti")
    open_.select("run_id", "chunk", "key", "frames", "text").write.mode("overwrite").partitionBy("run_id").json(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, chunk, key, reading`` from answer files of the same layout; the reply may have text around its JSON."""
    rows = spark.read.schema("chunk int, key string, reply string, run_id string").json(path)
    return rows.select("run_id", "chunk", "key", F.regexp_extract("reply", r"(?s)(\{.*\})", 1).alias("reading")).where("reading <> ''")


DELTA = "struct<requirements:array<struct<{requirements}>>,updates:array<struct<id:string,statement:string,reason:string>>,acceptance_criteria:array<struct<{acceptance_criteria}>>,questions:array<struct<{questions}>>>"


def resolve(t: Tables, caller: Caller, done: DataFrame | None = None, store: str | None = None) -> tuple[Tables, DataFrame]:
    """Answers worked in: one call for each run with answered questions that ``done`` (``run_id, id``) doesn't name, and
    what it gives merged. Returns the tables and the ids that are done now. Runs without such questions stay as they
    are and cost nothing. The replies are written to ``store``, or checkpointed, before anything uses them."""
    asked = feedback.answered(t["questions"], done)

    def call(rows):
        import pandas as pd

        rows = rows.sort_values("pos")
        text = "\n\n".join(f"{q.id}: {q.question}\nAnswer: {q.answer}" for q in rows.itertuples())
        reply = caller("Work the answers in.", text, [])
        return pd.DataFrame({"run_id": rows["run_id"].iloc[:1], "reply": [json.dumps(reply)]})

    replies = asked.select("run_id", "pos", "id", "question", "answer").groupBy("run_id").applyInPandas(call, "run_id string, reply string")
    if store:
        replies.write.mode("overwrite").parquet(store)
        replies = replies.sparkSession.read.parquet(store)
    elif replies.sparkSession.conf.get("spark.checkpoint.dir", None):
        replies = replies.checkpoint()
    else:
        raise ValueError("give a folder for the replies, or set spark.checkpoint.dir")
    parsed = replies.select("run_id", F.from_json("reply", DELTA.format(**schema.ENTITIES)).alias("r"))
    rows = lambda name: parsed.select("run_id", F.posexplode(f"r.{name}").alias("pos", "x")).select("run_id", "pos", "x.*")
    note = F.trim(F.concat(F.lit("Updated after the expert's answer: "), F.coalesce("reason", F.lit(""))))
    updates = rows("updates").select("run_id", "id", "statement", note.alias("note"))
    merged = feedback.merge_delta(t, rows("requirements"), updates, rows("acceptance_criteria"), rows("questions"))
    now = asked.select("run_id", "id")
    return merged, now if done is None else now.unionByName(done.select("run_id", "id"))
