"""Live sessions and whole runs with the stand-in for a model."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracewright import schema
from tracewright.operators import chunks, keyframes
from tracewright.plans import session
from tracewright.plans.model import FakeCaller, TooLong, read_in_halves
from tracewright.streaming import live

SCREENS = {s: f"{random.Random(s).getrandbits(672):0168x}" for s in "abcd"}


def shots():
    rows = [("r", float(10 * i), SCREENS["abcd"[i // 2]]) for i in range(8)]
    r = random.Random(2)
    return rows + [("q", float(i), SCREENS[r.choice("abcd")]) for i in range(40)]


def test_stream_keeps_what_a_batch_keeps(spark, tmp_path):
    rows = shots()
    ddl = "run_id string, t double, hash string"
    for n in range(4):  # in order of time, one file a micro-batch
        part = [x for i, x in enumerate(sorted(rows, key=lambda x: (x[0], x[1]))) if n * 12 <= i < n * 12 + 12]
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

    def write(df, n):
        df.write.mode("append").parquet(str(tmp_path / "out"))

    live.run_live(stream, write, str(tmp_path / "ck")).awaitTermination()
    live.run_live(stream, write, str(tmp_path / "ck")).awaitTermination()  # nothing new: nothing again
    got = {(x.run_id, x.frame, x.t) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(x.run_id, x.frame, x.t) for x in keyframes.keep_changed(spark.createDataFrame(rows, ddl)).collect()}
    assert got == want and {t for r, _, t in got if r == "r"} == {0.0, 20.0, 40.0, 60.0}


def test_rounds(spark):
    e = spark.createDataFrame([("r", float(t)) for t in range(0, 80, 10)] + [("q", 5.0)], "run_id string, t double")
    got = sorted((x.run_id, x.round, x.at) for x in live.rounds(e, 30.0).collect())
    assert got == [("q", 1, 5.0), ("r", 1, 30.0), ("r", 2, 60.0), ("r", 3, 70.0)]
    now = spark.createDataFrame([("a", 400.0, 5, 1), ("b", 200.0, 5, 1), ("c", 1.0, 1, 0), ("d", 1.0, 0, 3)], "run_id string, at double, frames int, segments int")
    then = spark.createDataFrame([("a", 90.0, 5, 1), ("b", 100.0, 4, 1)], "run_id string, at double, frames int, segments int")
    assert sorted(x.run_id for x in live.analyses_due(then, now).collect()) == ["a", "c"]
    assert sorted(x.run_id for x in live.analyses_due(then, now, force=True).collect()) == ["a", "b", "c"]


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a", "bad"):
        (tmp_path / "in" / f"{n}.vtt").write_text("x")
    seen = []

    def process(path, modified):
        if "bad" in path:
            raise ValueError("no good")
        seen.append(path)

    for _ in range(2):
        live.watch(spark, str(tmp_path / "in"), str(tmp_path / "ck"), process, str(tmp_path / "status")).awaitTermination()
    assert len(seen) == 1
    got = {x.path[-5:]: (x.state, x.error) for x in spark.read.parquet(str(tmp_path / "status")).collect()}
    assert got == {"a.vtt": ("ok", None), "d.vtt": ("error", "no good")}


def inputs(spark, words="hello", frames=10):
    f = spark.createDataFrame([("r", i, 10.0 * i) for i in range(frames)], "run_id string, index int, timestamp double")
    s = spark.createDataFrame([("r", i, 10.0 * i + 1, 10.0 * i + 4, words if i == 9 else f"say {i}", "Jo", []) for i in range(0, frames, 3)], f"run_id string, pos int, start double, `end` double, text string, speaker string, words {schema.WORDS}")
    return f, s


class Counting(FakeCaller):
    def __init__(self, log, **k):
        super().__init__(**k)
        self.log = log

    def __call__(self, task, text, frames):
        with open(self.log, "a") as f:
            f.write(f"{frames[0]} {task.count('- S')}\n")
        return super().__call__(task, text, frames)


def test_run_and_reuse(spark, tmp_path):
    log = str(tmp_path / "calls")
    one = session.run(*inputs(spark), Counting(log), store=str(tmp_path / "one"))
    t = {k: v.orderBy("pos").collect() for k, v in one.tables.items()}
    assert [s.id for s in t["screens"]] == ["S01", "S02", "S03", "S04"] and len(t["journey"]) == 10
    assert [(r.id, r.source_quote) for r in t["requirements"]][0] == ("R001", "Jo: say 0") and len(t["requirements"]) == 4
    assert open(log).read().split("\n")[:2] == ["0 0", "8 4"]
    two = session.run(*inputs(spark, words="other"), Counting(log), prior=one.readings, store=str(tmp_path / "two"))
    assert [r.source_quote for r in two.tables["requirements"].orderBy("pos").collect()][-1] == "Jo: other"
    assert open(log).read().split("\n")[2:3] == ["8 4"] and open(log).read().count("\n") == 3
    assert two.readings.count() == 2 and chunks.unread(two.requests, one.readings).count() == 1


def test_halves():
    parts = [(i, f"Frame {i} from 00:00 to 00:01\nSaid: x") for i in range(5)]
    replies = read_in_halves(FakeCaller(most_frames=2), "", parts)
    assert [len(r["screens"]) for r in replies] == [2, 1, 2]
    with pytest.raises(TooLong):
        read_in_halves(FakeCaller(most_frames=0), "", parts)


def test_offline(spark, tmp_path):
    m, asked = session.plan(*inputs(spark))
    session.write_requests(asked, str(tmp_path / "req"))
    reqs = spark.read.json(str(tmp_path / "req")).collect()
    assert sorted(x.chunk for x in reqs) == [0, 1]
    fake = FakeCaller()
    answers = [{"chunk": x.chunk, "key": x.key, "reply": "Here: " + json.dumps(fake("", x.text, list(x.frames))), "run_id": "r"} for x in reqs if x.chunk == 0]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, answers)))
    got = session.read_answers(spark, str(tmp_path / "a.json"))
    assert session.consolidate(got)["journey"].count() == 8
    session.write_requests(asked, str(tmp_path / "req2"), got)
    assert [x.chunk for x in spark.read.json(str(tmp_path / "req2")).collect()] == [1]


def test_budget(spark):
    m, _ = session.plan(*inputs(spark))
    rows = m.select("run_id", "start", chunks.spoken(F.col("segments")).alias("text"), *(F.lit(None).cast("int").alias(c) for c in ("width", "height", "crop_width", "crop_height")), F.lit(None).cast("string").alias("ocr"))
    tr = chunks.transcript(inputs(spark)[1])
    prices = spark.createDataFrame([("s", 1.0, 5.0), ("l", 5.0, 25.0)], "model string, input double, output double")
    assert session.within_budget(rows, tr, prices, 1.0).count() == 2
    with pytest.raises(session.OverBudget):
        session.within_budget(rows, tr, prices, 0.001)


def test_progress_is_windowed(spark, tmp_path):
    spark.createDataFrame([("r", "2024-01-01 00:01:00"), ("r", "2024-01-01 00:04:00"), ("r", "2024-01-01 00:07:00")], "run_id string, ts string").write.json(str(tmp_path / "e"))
    s = spark.readStream.schema("run_id string, ts timestamp").json(str(tmp_path / "e"))
    q = live.progress(s).writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(x.n for x in spark.sql("select * from progress").collect()) == [1, 2]


def test_shifted_chunks(spark):
    from tracewright.streaming import live

    seg = spark.createDataFrame([("r", 0, 1.0, 2.0, [(1.0, 1.5, "a")]), ("r", 1, 0.5, 3.0, []), ("r", 9, 0.5, 1.0, None)], "run_id string, chunk int, start double, `end` double, words array<struct<start:double,`end`:double,text:string>>")
    chunks = spark.createDataFrame([("r", 0, 0.0), ("r", 1, 30.0)], "run_id string, chunk int, start double")
    got = {x.chunk: x for x in live.shifted(seg, chunks).collect()}
    assert (got[1].start, got[1].end) == (30.5, 33.0) and got[0].words[0].end == 1.5 and got[9].start == 0.5 and got[9].words is None
