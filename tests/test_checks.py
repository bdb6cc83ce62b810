"""Gaps, writing rules, flow, alignment and scalar functions on a small made-up walkthrough."""

import pytest
from pyspark.sql import functions as F

from tests import fixtures
from tracewright import schema
from tracewright.functions import text as T
from tracewright.operators import align, flow, gaps, lint


@pytest.fixture(scope="module")
def t(spark):
    return fixtures.tables(spark)


def test_gaps(spark, t):
    got = [(g.kind, g.item_id, g.severity) for g in gaps.find_gaps(t).orderBy("pos").collect()]
    assert got == [
        ("screen without requirements", "S02", "warn"), ("screen without requirements", "S04", "warn"), ("screen without fields", "S04", "warn"),
        ("field never mentioned", "F002", "warn"), ("field never mentioned", "F004", "warn"),
        ("requirement without criteria", "R10", "warn"), ("requirement without screen", "R10", "warn"), ("action leading nowhere", "A002", "warn"),
        ("journey step not in a requirement", "J2", "warn"), ("requirement without screen", "R2", "info"), ("low-confidence requirement", "R2", "info"),
        ("question with no screen", "Q2", "info"), ("actor never named in a requirement", "Borrower", "info"),
    ]
    line = gaps.summary(gaps.find_gaps(t), t["screens"].select("run_id").distinct()).first().summary
    assert line.startswith("9 gaps to close: 2 screens without requirements, 1 screen without fields, 2 fields never mentioned") and line.endswith("; 4 notes.")
    nowhere = gaps.fields_never_mentioned(t).where("item_id = 'F004'").first()
    assert "on the S09 screen" in nowhere.detail
    assert gaps.summary(gaps.find_gaps(t).limit(0), spark.createDataFrame([("x",)], "run_id string")).first().summary == "No gaps found."


def rules(spark, text):
    return [(f.rule, f.severity) for f in spark.createDataFrame([(text,)], "s string").select(lint.requirement_findings(F.col("s")).alias("f")).first().f]


@pytest.mark.parametrize(
    "text,want",
    [
        ("The system must save the loan", []),
        ("", [("empty-clause", "warn")]),
        ("The desk shows names and cards or unless told then it stops", [("joined-clauses", "info")] + [("joined-clauses", "warn")] * 3),
        ("The desk must be user-friendly, where possible, etc", [("vague-word", "warn"), ("escape-clause", "warn"), ("open-ended-list", "warn")]),
        ("As a clerk, I save it so that I see this and that", []),
        ("save the loan", [("missing-actor", "info")]),
        ("Clerk saves the loan", []),
        ("The loan is quickly saved in the database", [("vague-word", "warn"), ("implementation-word", "info"), ("passive-voice", "info")]),
        ("The door was open", []),
        ("The system must never fail 100% of " + "x " * 40, [("too-long", "warn"), ("absolute", "info"), ("absolute", "info")]),
        ("The sort-or-merge API-like thing", []),
    ],
)
def test_requirement_rules(spark, text, want):
    assert rules(spark, text) == want


def test_criteria_and_summary(t):
    linted = lint.lint(t["requirements"], t["criteria"])
    by = {(x.target, x.id): [f.rule for f in x.findings] for x in linted.collect()}
    assert by["criterion", "AC1"] == ["no-outcome"]
    assert by["criterion", "AC2"] == ["empty-clause", "joined-clauses"]
    assert by["criterion", "AC3"] == ["no-outcome"]
    assert by["requirement", "R2"] == ["joined-clauses", "escape-clause"]
    s = lint.writing_summary(linted).first()
    assert (s.requirements_with_warnings, s.criteria_with_warnings) == (2, 3) and s.summary.startswith("2 requirements and 3 criteria have warnings; ")
    assert lint.exploded(linted).where("id = 'AC1'").count() == 1


def test_flow(t):
    n = [(x.id, x.order, x.n_fields, x.n_actions) for x in flow.nodes(t).orderBy("order").collect()]
    assert n == [("S01", 1, 2, 2), ("S02", 2, 1, 3), ("S03", 3, 1, 0), ("S04", 4, 0, 0)]
    e = [(x.from_id, x.to_id, x.kind, x.label) for x in flow.edges(t).orderBy("pos").collect()]
    assert e == [
        ("S01", "S02", "action", "Presses Search"), ("S01", "S03", "journey", ""), ("S02", "S03", "action", "Opens Fines"), ("S02", "S01", "journey", ""),
    ]
    assert [(x.x, x.y) for x in flow.layout(flow.nodes(t)).orderBy("order").collect()][:2] == [(0, 0), (240, 0)]


WORD = schema.WORDS


def segs(spark, *rows):
    return spark.createDataFrame([("r", i, *x) for i, x in enumerate(rows)], f"run_id string, pos int, start double, `end` double, text string, speaker string, words {WORD}")


@pytest.mark.parametrize(
    "seg,estimate,want",
    [
        ((4.0, 8.0, "aaaa bbbb cccc dddd eeee ffff gggg hhhh", None, []), True, {0: (4.0, 6.0, "aaaa bbbb cccc dddd"), 1: (6.0, 8.0, "eeee ffff gggg hhhh")}),
        ((4.0, 7.0, "one two", None, []), False, {0: (4.0, 7.0, "one two")}),
        ((4.0, 8.0, "one two", None, []), False, {1: (4.0, 8.0, "one two")}),
        ((4.0, 8.0, "a b", None, [(4.0, 5.0, "a"), (5.5, 8.0, "b")]), True, {0: (4.0, 8.0, "a b")}),
        ((4.0, 8.0, "a b", "Jo", [(4.0, 5.0, "a"), (6.0, 8.0, "b")]), True, {0: (4.0, 5.0, "a"), 1: (6.0, 8.0, "b")}),
    ],
)
def test_moments(spark, seg, estimate, want):
    frames = spark.createDataFrame([("r", 2, 12.0), ("r", 0, 0.0), ("r", 1, 6.0)], "run_id string, index int, timestamp double")
    got = align.moments(frames, segs(spark, seg), spark.createDataFrame([("r", 18.0)], "run_id string, duration double"), estimate).collect()
    assert sorted((x["index"], x["start"], x["end"]) for x in got) == [(0, 0.0, 6.0), (1, 6.0, 12.0), (2, 12.0, 18.0)]
    assert {x["index"]: (p.start, p.end, p.text) for x in got for p in x.segments} == want


def test_boundaries(spark):
    m = spark.createDataFrame([("r", 0, 0.0, 5.0, "a"), ("r", 1, 5.0, 130.0, "b")], "run_id string, pos int, start double, `end` double, name string")
    p = spark.createDataFrame([("r", 5.0), ("r", 130.0), ("r", 131.0), ("q", 1.0)], "run_id string, t double")
    assert sorted((x.t, x.name or "") for x in align.first_closed(p, m, ["run_id"], "t", ["name"]).collect()) == [(1.0, ""), (5.0, "a"), (130.0, "b"), (131.0, "")]
    turns = spark.createDataFrame([("r", 0, 0.0, 4.0, "x"), ("r", 1, 4.0, 90.0, "y"), ("r", 2, 8.0, 12.0, "z")], "run_id string, pos int, start double, `end` double, who string")
    s = spark.createDataFrame([("r", 1, 2.0, 6.0), ("r", 2, 7.0, 200.0), ("r", 3, 95.0, 99.0)], "run_id string, id int, start double, `end` double")
    assert sorted((x.id, x.who) for x in align.most_overlap(s, turns, ["run_id"], "who").collect()) == [(1, "x"), (2, "y"), (3, None)]


def test_scalars(spark):
    def one(c):
        return spark.range(1).select(c.alias("v")).first().v

    L = F.lit
    assert [one(T.mmss(L(x))) for x in (65.9, 3725.0, -1.0)] == ["01:05", "1:02:05", "00:00"]
    assert one(T.parse_time(L("[1:02:03,5]"))) == 3723.5 and one(T.parse_time(L("PT1H1S"))) == 3601.0 and one(T.parse_time(L("soon"))) is None
    assert one(T.norm(L("  Straße\t A "))) == "strasse a"
    assert [one(T.singular(L(x))) for x in ("entries", "boxes", "class", "details", "ties")] == ["entry", "box", "class", "detail", "tie"]
    assert one(T.matches_all(L("Save the Loan"), F.array(L("save|store"), L(" loan | ")))) and not one(T.matches_all(L("x"), F.array(L("|"))))
    assert one(T.region_name(L(0), L(0), L(10), L(10), L(0.1), L(90), L(90))) == "top left" and one(T.region_name(L(40), L(40), L(10), L(10), L(0.1), L(90), L(90))) == "centre"
    assert one(T.hamming_hex(L("f" * 20), L("e" * 20))) == 20
    assert one(T.cut(L("x " * 300))).endswith("\u2026") and len(one(T.cut(L("x " * 300)))) <= 250
    assert one(T.html(L("<a&'\">"))) == "&lt;a&amp;&#x27;&quot;&gt;"
    df = spark.createDataFrame([("R10",), ("R2",), ("AC1",), ("R2b",)], "id string")
    assert [x.id for x in df.orderBy(T.natural_key(F.col("id"))).collect()] == ["AC1", "R2", "R2b", "R10"]
