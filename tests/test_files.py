"""Transcripts, stored documents, tickets and pages."""

import csv
import glob
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tests import fixtures
from tracewright import schema
from tracewright.operators import compare
from tracewright.sinks import pages, tickets
from tracewright.sources import documents, transcripts

VTT = "﻿WEBVTT\n\nNOTE about\nthis\n\n1\n00:00:01.000 --> 00:00:04.000 align:start\n<v Jo Smith>Hello <b>there</b>\nfriend\n\n00:05.000 --> 00:03.000\nplain\n"
SRT = "1\r\n00:00:01,500 --> 00:00:02,000\r\nOne\r\nmore\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\nTwo\r\n"
PLAIN = "intro\n00:01 first words here\n[0:05] - second\n1:00:00 the last one of all\n"
WRAPPED = {"meta": {"v": 1}, "data": {"results": [{"startTime": "00:02", "dur": 3, "content": " hi ", "speaker": {"displayName": "Al"}}, {"content": "no time"}, {"from": 5, "to": "00:04", "value": "late"}, 7]}}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("t")
    for name, text in {"a.vtt": VTT, "b.srt": SRT, "c.txt": PLAIN, "d.json": json.dumps(WRAPPED), "e.txt": SRT, "f.json": json.dumps([{"start": 1, "text": "x", "speaker": "Jo"}, {"start": True, "text": "y"}])}.items():
        (d / name).write_text(text, encoding="utf-8")
    return d


def test_transcripts(spark, folder):
    got = {}
    for x in transcripts.read(spark, str(folder)).orderBy("pos").collect():
        got.setdefault(x.run_id.rsplit("/", 1)[1][0], []).append((x.start, x.end, x.text, x.speaker))
    assert got["a"] == [(1.0, 4.0, "Hello there friend", "Jo Smith"), (5.0, 3.0, "plain", None)]
    assert got["b"] == got["e"] == [(1.5, 2.0, "One more", None), (3.0, 4.0, "Two", None)]
    assert got["c"] == [(1.0, 5.0, "first words here", None), (5.0, 3600.0, "second", None), (3600.0, 3602.0, "the last one of all", None)]
    assert got["d"] == [(2.0, 5.0, "hi", "Al"), (5.0, 5.0, "late", None)]
    assert got["f"] == [(1.0, 1.0, "x", "Jo")]


def test_bad_times_are_errors(spark):
    df = spark.createDataFrame([("x.vtt", "WEBVTT\n\n1:2:3:4 --> 00:02\nhi")], "run_id string, value string")
    with pytest.raises(Exception, match="not a time"):
        transcripts.parse(df).collect()


def test_notes(spark):
    text = "# Start\n\nOpen the desk\nand wait\n\n- one\n- two\n\n## Later\n\n1. three\n2) four\n\n# Alone\n"
    df = spark.createDataFrame([("r", text)], "run_id string, value string")
    assert [x.text for x in transcripts.split_notes(df).orderBy("pos").collect()] == ["Start: Open the desk and wait", "one", "two", "Later: three", "four"]


def test_documents(spark, tmp_path):
    a = fixtures.analysis(spark).drop("run_id")
    (tmp_path / "analysis.json").write_text(a.toJSON().first())
    t = schema.entities(documents.read_analyses(spark, str(tmp_path / "analysis.json")))
    assert t["fields"].count() == 5 and t["actors"].count() == 2
    bad = json.loads(a.toJSON().first())
    bad["requirements"][0]["confidence"] = "perhaps"
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    with pytest.raises(Exception, match="confidence"):
        documents.read_analyses(spark, str(tmp_path / "bad.json")).select("title").collect()
    ocr = spark.createDataFrame([("r", '{"3": "three", "x": "no"}')], "run_id string, value string")
    assert [(x["index"], x["text"]) for x in documents.ocr_cache(ocr).collect()] == [(3, "three")]
    broken = spark.createDataFrame([("r", "{nope")], "run_id string, value string")
    assert documents.ocr_cache(broken, tolerant=True).count() == 0
    with pytest.raises(Exception):
        documents.ocr_cache(broken).collect()
    r = spark.createDataFrame([('Sure! ```{"a": 1}``` bye',), ("none",)], "v string").select(documents.reply(F.col("v"), "a int").alias("r")).collect()
    assert r[0].r.a == 1 and r[1].r is None


def test_watch(spark):
    rows = [("/w/a.mp4", 5), ("/w/a.txt", 1), ("/w/a.srt", 1), ("/w/shots/1.png", 3), ("/w/shots/2.txt", 9), ("/w/empty/x.txt", 1), ("/w/.hid/1.png", 1), ("/w/b.mkv", 2)]
    items = documents.watch_items(spark.createDataFrame(rows, "path string, modificationTime long"), "/w")
    got = {x.stem: (x.kind, x.modified, x.transcript) for x in items.collect()}
    assert got == {"a": ("video", 5, "/w/a.srt"), "b": ("video", 2, None), "shots": ("screenshots", 9, None)}
    done = spark.createDataFrame([("a", 4), ("b", 2)], "stem string, modified long")
    assert sorted((x.stem, x.reprocess) for x in documents.pending(items, done).collect()) == [("a", True), ("shots", False)]


@pytest.fixture(scope="module")
def t(spark):
    return fixtures.tables(spark)


def frames(spark):
    return spark.createDataFrame([("a", i, float(i), f"frames/frame_{i:04d}.jpg") for i in range(3)], "run_id string, index int, timestamp double, path string")


def test_tickets(spark, t, tmp_path):
    j = {x["Issue ID"]: x for x in tickets.jira(t, frames(spark), "wt").collect()}
    assert j["R1"]["Labels"] == "wt functional member-search" and j["R1"]["Priority"] == "Highest" and j["Q1"]["Labels"] == "wt question rules fines"
    assert "* *Given* a member exists *When* the name is typed *Then* it works" in j["R1"]["Description"] and "Frame: frame_0000.jpg" in j["R1"]["Description"]
    assert "* None yet." in j["R10"]["Description"] and "Frame: frame 3" in j["R10"]["Description"] and j["R2"]["Description"].startswith("Members forget\n\nh3.")
    a = tickets.azure(t, frames(spark), "wt").where("part = 0 and pos = 0").first()
    assert a["Acceptance Criteria"].startswith("<ul><li><b>Given</b> a member exists") and a["Priority"] == "1" and a["Tags"] == "wt; functional; member-search"
    tickets.write_csv(tickets.jira(t, frames(spark)), str(tmp_path / "j"))
    (path,) = glob.glob(str(tmp_path / "j" / "*.csv"))
    rows = list(csv.reader(open(path, encoding="utf-8", newline="")))
    assert len(open(path, "rb").read().split(b'"Story"')) == 4 and rows[0] == tickets.JIRA


def test_pages(spark, t, tmp_path):
    segs = spark.createDataFrame([("a", 0, 1.0, "Jo", "hi")], "run_id string, pos int, start double, speaker string, text string")
    made = pages.export(t, "Desk & co", str(tmp_path), segments=segs)
    md = made["report.md"].read_text()
    assert "## Requirements" in md and "| R1 | As a librarian" in md and "## Gaps" in md and "| 00:01 | Jo | hi |" in md
    assert "<title>Desk &amp; co</title>" in made["report.html"].read_text() and "<h2>Glossary</h2>" in made["wiki.xhtml"].read_text()
    assert 'n1["Member search"]' in made["flow.mmd"].read_text()
    with zipfile.ZipFile(made["analysis.xlsx"]) as z:
        assert z.testzip() is None and "Member search" in z.read("xl/worksheets/sheet3.xml").decode()
    q = pages.live_questions(t["questions"], 65.0)
    assert q.index("## Q1") < q.index("## Q2") and "Updated at 01:05. 2 questions" in q and "(blocks R10, R2)" in q
    other = dict(t) | {"screens": t["screens"].withColumn("name", F.when(F.col("id") == "S03", "Fine list").otherwise(F.col("name")))}
    text = pages.comparison(compare.compare(compare.items(t, "a").unionByName(compare.items(other, "b"))))
    assert "- screen: S03 Fines -> S03 Fine list" in text


def test_wiki_targets_and_html_comparison(spark):
    from tracewright.sinks import pages

    sheets = [("A & B", ["x"], [["<1>"]]), ("None", ["y"], [])]
    one, two = (pages.wiki_page("T & t", sheets, x) for x in ("confluence", "sharepoint"))
    assert 'xmlns="http://www.w3.org/1999/xhtml"' in one and "xmlns" not in two and "<title>T &amp; t</title>" in two and "&lt;1&gt;" in one
    rows = [("p", "field", "changed", "F1", "a<b", "frame 1 @ 00:01", "F2", "a>b", None, 0), ("p", "screen", "added", None, None, None, "S1", "New", None, 1)]
    df = spark.createDataFrame(rows, "pair_id string, kind string, change string, id_a string, text_a string, frame_a string, id_b string, text_b string, frame_b string, pos int")
    page = pages.comparison_html(df, "x", "y")
    assert "a&lt;b" in page and "&rarr;" in page and "Nothing was removed." in page and '<span class="id">S1</span> New' in page and "frame 1 @ 00:01" in page
