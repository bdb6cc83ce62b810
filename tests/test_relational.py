"""Merging, scoring, comparing, glossary, key frames, chunks, feedback and cost."""

import difflib
import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import fixtures
from tracewright import schema
from tracewright.operators import chunks, compare, cost, feedback, glossary, keyframes, merge, score


@pytest.fixture(scope="module")
def t(spark):
    return fixtures.tables(spark)


@pytest.fixture(scope="module")
def merged(spark):
    both = fixtures.analysis(spark, "a").unionByName(fixtures.analysis(spark, "b"))
    runs = spark.createDataFrame([("a", 0, 6, 300.0), ("b", 1, 4, 150.0)], "run_id string, position int, frames int, duration double")
    return merge.merge(schema.entities(both), runs), runs


def col(df, *names):
    return [tuple(r) if len(names) > 1 else r[0] for r in df.orderBy("pos").select(*names).collect()]


def test_merge_folds_and_repairs(merged):
    m, _ = merged
    assert col(m["screens"], "id") == ["S01", "S02", "S03", "S04"]
    assert col(m["screens"], "keyframe_indexes")[1] == [1, 2, 7, 8] and col(m["screens"], "first_seen")[1] == 30.0
    assert col(m["fields"], "id", "screen_id") == [("F001", "S01"), ("F002", "S01"), ("F003", "S02"), ("F004", "A-S09"), ("F005", "S03"), ("F006", "B-S09")]
    assert len(col(m["actions"], "id")) == 10 and col(m["journey"], "order") == list(range(1, 9))
    assert col(m["requirements"], "id") == ["R001", "R002", "R003"] and col(m["requirements"], "screen_id") == ["S01", None, None]
    assert col(m["criteria"], "id", "requirement_id") == [("AC001", "R001"), ("AC002", "R002"), ("AC003", "R001"), ("AC004", "R002")]
    assert col(m["questions"], "id", "blocks_requirement_ids") == [("Q001", ["R003", "R002"]), ("Q002", ["R001"])]
    assert col(m["actors"], "actor") == ["Librarian", "Borrower"]
    assert col(m["actions"], "timestamp")[5] == 303.0 and col(m["actions"], "keyframe_index")[5] == 6
    assert col(m["screens"], "field_ids")[0] == ["F001", "F002"]


def test_assemble_round_trip(spark):
    a = fixtures.analysis(spark)
    heads = a.select("run_id", "title", "summary", "usage")
    assert schema.assemble(schema.entities(a), heads).first() == a.first()


def test_renumber_duplicates(spark, t):
    dup = dict(t)
    dup["screens"] = t["screens"].withColumn("id", F.when(F.col("id") == "S03", "S01").otherwise(F.col("id")))
    out = merge.renumber(dup)
    assert col(out["screens"], "id") == ["S03", "S02", "S03", "S04"] and col(out["fields"], "screen_id")[0] == "S03"


def test_prefix_and_usage(spark):
    p = spark.range(30).select(merge.prefix(F.col("id")).alias("p")).collect()
    assert [p[i].p for i in (0, 25, 26, 27)] == ["A-", "Z-", "AA-", "AB-"]
    both = fixtures.analysis(spark, "a").withColumn("position", F.lit(0)).unionByName(fixtures.analysis(spark, "b").withColumn("position", F.lit(1)))
    u = merge.summed_usage(both).first()
    assert (u.model, u.calls, u.input_tokens) == ("m", 4, 20)


KEY = [
    ("screens", 0, ["search|find"], None), ("screens", 1, ["loan", "desk"], None), ("screens", 2, ["report"], None),
    ("fields", 0, ["member name"], ["search"]), ("fields", 1, ["member name"], ["fines"]), ("fields", 2, ["shelf"], ["loan"]),
    ("requirements", 0, ["member"], None), ("requirements", 1, ["member"], None), ("requirements", 2, ["member"], None),
]


def test_score(spark, t):
    key = spark.createDataFrame(KEY, "category string, pos int, groups array<string>, screen_groups array<string>")
    runs = spark.createDataFrame([("a",)], "run_id string")
    s = {r.category: (r.expected, r.found, round(r.recall, 4), r.extras) for r in score.score(t, key, runs).collect()}
    assert s == {"screens": (3, 2, 0.6667, 2), "fields": (3, 2, 0.6667, 3), "actions": (0, 0, 0.0, 5), "requirements": (3, 2, 0.6667, 1), "questions": (0, 0, 0.0, 2)}
    assert round(score.overall(score.score(t, key, runs)).first().overall_recall, 4) == 0.6667
    assert sorted((r.category, r.pos) for r in score.missed(t, key, runs).collect()) == [("fields", 2), ("requirements", 2), ("screens", 2)]
    assert tuple(score.traceability(t, runs).first()) == ("a", 1, 1, 1)


def brute_compare(a, b):
    a, b = dict(a), dict(b)
    for i, x in list(a.items()):
        j = next((j for j, y in b.items() if y == x), None)
        if j is not None:
            del a[i], b[j]
    cand = [(difflib.SequenceMatcher(None, x, y).ratio(), i, j) for i, x in a.items() for j, y in b.items()]
    pairs = []
    for r, i, j in sorted((c for c in cand if c[0] >= 0.5), key=lambda c: -c[0]):
        if i in a and j in b:
            pairs.append((i, j))
            del a[i], b[j]
    return sorted(pairs), sorted(a), sorted(b)


def test_compare(spark, t):
    r = random.Random(5)
    words = "open close save find member loan fine card name date".split()
    side = {s: {f"{s}{i}": " ".join(r.choice(words) for _ in range(r.randrange(1, 5))) for i in range(25)} for s in "ab"}
    rows = [("p", "field", s, i, n, x.upper() if n % 2 else x, None) for s, d in side.items() for n, (i, x) in enumerate(d.items())]
    df = spark.createDataFrame(rows, "pair_id string, kind string, side string, id string, pos int, text string, frame string")
    out = compare.compare(df).collect()
    got = (sorted((x.id_a, x.id_b) for x in out if x.change == "changed"), sorted(x.id_a for x in out if x.change == "removed"), sorted(x.id_b for x in out if x.change == "added"))
    assert got == brute_compare(side["a"], side["b"])
    items = compare.items(t, "a").unionByName(compare.items(t, "b"))
    assert compare.compare(items).count() == 0


def test_glossary(t):
    g = glossary.build(t)
    rows = {(x.kind, x.term): x for x in g.collect()}
    assert [k for k, _ in rows][:2] == ["role", "role"]
    assert rows["role", "Librarian"].first_seen == 1.0 and rows["role", "Librarian"].used_in == ["R1"]
    assert rows["field", "Member name"]["where"] == "Member search and Fines screens" and rows["field", "Member name"].used_in == ["R1"]
    assert rows["action", "Return"]["where"] == "button on Loan desk screen" and rows["action", "Search"].first_seen == 3.0
    assert rows["status value", "On loan"]["where"] == 'value of the "Loan status" field on Loan desk screen'
    f = glossary.findings(g, t).collect()
    assert any("appears on 2 screens (Member search, Fines as \"member name\")" in x.finding for x in f)
    notes = {x.term: x.notes for x in glossary.with_findings(g, glossary.findings(g, t)).collect()}
    assert notes["Member name"].startswith('Info: the field "Member name"') and notes["Borrower"] == ""


@pytest.mark.parametrize("text,want", [("Presses Save and continue", "Save and continue"), ('Clicks the "Approve" button', "Approve"), ("Opens the Fines menu to see", "Fines"), ("Scans the card", None), ("opens it", None)])
def test_control_names(spark, text, want):
    assert spark.range(1).select(glossary.control_name(F.lit(text)).alias("c")).first().c == want


def test_near_duplicates(spark):
    terms = ["Post code", "postcode", "Detail", "Details", "Customer", "Custmer", "Save", "Fail", "SAVE"]
    e = spark.createDataFrame([("r", i, x, "field", "w") for i, x in enumerate(terms)], "run_id string, pos int, term string, kind string, where string")
    got = {(x[0], x[1]): x[2] for x in glossary.near_duplicates(e).select(F.col("a.term"), F.col("b.term"), "reason").collect()}
    assert got == {("Post code", "postcode"): "spacing", ("Detail", "Details"): "plural", ("Customer", "Custmer"): "letters", ("Save", "SAVE"): "capitals"}


def test_keep_changed(spark):
    screens = {s: f"{random.Random(s).getrandbits(672):0168x}" for s in "abcd"}
    rows = [("r", float(i), screens["abcd"[i // 3]]) for i in range(12)] + [("still", float(i), screens["a"]) for i in range(25)]
    df = spark.createDataFrame(rows, "run_id string, t double, hash string").repartition(4)
    keep = lambda **k: {r: [x.t for x in g] for r, g in group(keyframes.keep_changed(df, **k).orderBy("run_id", "frame").collect()).items()}
    assert keep()["r"] == [0.0, 3.0, 6.0, 9.0]
    assert keep(min_gap=4.0)["r"] == [0.0, 4.0, 8.0]
    assert keep(fallback=10.0)["still"] == [0.0, 10.0, 20.0]
    assert keyframes.extract(df, most=3).where("run_id = 'r'").count() == 3


def group(rows):
    out = {}
    for x in rows:
        out.setdefault(x.run_id, []).append(x)
    return out


def test_survivors_against_a_heap():
    r = random.Random(8)
    for _ in range(30):
        h = [f"{r.getrandbits(64):016x}" for _ in range(r.randrange(1, 40))]
        bits, alive = [int(x, 16) for x in h], list(range(len(h)))
        while len(alive) > 10:
            d = [((bits[alive[k]] ^ bits[alive[k - 1]]).bit_count(), alive[k]) for k in range(1, len(alive))]
            heapq.heapify(d)
            alive.remove(heapq.heappop(d)[1])
        assert keyframes.survivors(h, 10) == alive


def test_hashes_of_pictures(spark):
    img = np.full((240, 320, 3), 255, np.uint8)
    img[40:60, 30:200] = 30
    green, red = img.copy(), img.copy()
    green[100:200, :, (0, 2)] = 20
    red[100:200, :, (1, 2)] = 20
    far = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert len(keyframes.frame_hash(img)) == 168 and len(keyframes.layout_hash(img)) == 16
    assert far(keyframes.frame_hash(green), keyframes.frame_hash(red)) > 8 and far(keyframes.frame_hash(img), keyframes.frame_hash(img.copy())) == 0
    assert keyframes.changed_box(img, green)[:4] == (0, 100, 320, 100) and keyframes.changed_box(img, img) is None
    df = spark.createDataFrame([("r", i, x.tobytes(), 320, 240) for i, x in enumerate((img, img, green))], "run_id string, index int, pixels binary, width int, height int")
    out = {x["index"]: x.change_from_previous for x in keyframes.annotate(df).collect()}
    assert out[0] is None and out[1] is None and (out[2].y, out[2].h) == (100, 100)
    assert keyframes.with_hash(df).select("hash").distinct().count() == 2


def test_screenshots_and_notes(spark):
    names = ["shot_5.png", "Screenshot 2026-01-02 at 10.04.33 AM.png", "2026-01-02T10-05-03.png", "IMG_10.png", "IMG_2.png"]
    df = spark.createDataFrame([("r", n) for n in names] + [("q", "b2.png"), ("q", "b10.png")], "run_id string, name string")
    got = {x.name: x.timestamp for x in keyframes.screenshot_times(df).collect()}
    assert got == {names[0]: 5.0, names[1]: 0.0, names[2]: 30.0, "IMG_2.png": 40.0, "IMG_10.png": 50.0, "b2.png": 0.0, "b10.png": 10.0}
    frames = spark.createDataFrame([("r", 0, 0.0, 10.0), ("r", 1, 10.0, 20.0)], "run_id string, index int, start double, `end` double")
    notes = spark.createDataFrame([("r", i, f"n{i}") for i in range(3)], "run_id string, pos int, text string")
    assert [(x.start, x.end) for x in keyframes.spread_notes(notes, frames).orderBy("pos").collect()] == [(0.0, 5.0), (5.0, 10.0), (10.0, 20.0)]


SEG = schema.SEGMENT


def test_chunks(spark):
    seg = lambda *x: [(0.0, 1.0, text, who, []) for who, text in x]
    rows = [("r", i, float(i), i + 1.0, seg(("Jo", "hi"), (None, " "), (None, "there"), ("Jo", "again"), ("Al", "yes")) if i == 0 else []) for i in range(10)]
    m = spark.createDataFrame(rows, f"run_id string, index int, start double, `end` double, segments array<{SEG}>")
    assert m.where("index = 0").select(chunks.spoken(F.col("segments")).alias("s")).first().s == "Jo: hi there again Al: yes"
    c = chunks.numbered(m, 8)
    assert sorted(x.chunk for x in c.collect()) == [0] * 8 + [1] * 2
    k = {x.chunk: x.key for x in chunks.keys(c).collect()}
    again = chunks.keys(chunks.numbered(m.withColumn("end", F.when(F.col("index") == 9, 99.0).otherwise(F.col("end"))), 8))
    left = chunks.unread(again, chunks.keys(c)).collect()
    assert len(k) == 2 and [x.chunk for x in left] == [1]
    text = {x.chunk: x.text for x in chunks.requests(c).collect()}
    assert text[0].startswith("Frame 0 from 00:00 to 00:01\nSaid: Jo: hi there again Al: yes\n\nFrame 1") and "(nothing said)" in text[1]


def test_feedback(spark, t):
    sheet = spark.createDataFrame([("Q1", "The desk lead", "Open", 1), ("Q2", None, "Done", 1), ("Q9", "x", None, 1), ("Q3", None, None, 1)], "ID string, Answer string, STATUS string, n int")
    got = {x.id: (x.answer, x.status) for x in feedback.sheet_answers(sheet).collect()}
    assert got == {"Q1": ("The desk lead", None), "Q2": (None, "answered"), "Q9": ("x", "answered")}
    web = spark.createDataFrame([('{"Q1": {"answer": "me", "status": "open"}, "Q2": {"answer": " ", "status": "not needed"}, "Q4": {"status": "open"}}',)], "value string")
    assert {x.id: (x.answer, x.status) for x in feedback.exported_answers(web).collect()} == {"Q1": ("me", "answered"), "Q2": (None, "not needed")}
    q = t["questions"].select("id", "answer", "status")
    up = {x.id: (x.answer, x.status, x.changed) for x in feedback.upsert(q, feedback.sheet_answers(sheet), ["id"], ["answer", "status"]).collect()}
    assert up["Q1"] == ("The desk lead", "open", True) and up["Q2"] == ("Yes, by checksum", "answered", False)
    assert [x.id for x in feedback.unknown(q, feedback.sheet_answers(sheet), ["id"]).collect()] == ["Q9"]
    assert [x.id for x in feedback.answered(t["questions"]).collect()] == ["Q2"]
    assert [x.id for x in feedback.ask_first(t["questions"]).orderBy("rank").collect()] == ["Q1", "Q2"]


def test_delta(spark, t):
    new = t["requirements"].limit(1).withColumn("id", F.lit("N1")).withColumn("screen_id", F.lit("S77")).withColumn("pos", F.lit(0))
    upd = spark.createDataFrame([("a", "R1", "New wording", "Answered: yes")], "run_id string, id string, statement string, note string")
    crit = t["criteria"].where("id = 'AC1'").withColumn("requirement_id", F.lit("N1")).unionByName(t["criteria"].where("id = 'AC3'"))
    ask = t["questions"].where("id = 'Q2'")
    out = feedback.merge_delta(t, new, upd, crit, ask)
    assert col(out["requirements"], "id", "screen_id")[-1] == ("R011", None)
    assert col(out["requirements"], "statement", "rationale")[0] == ("New wording", "Answered: yes")
    assert col(out["criteria"], "id", "requirement_id")[3:] == [("AC004", "R011")]
    assert col(out["questions"], "id", "status", "answer")[-1] == ("Q003", "open", None)


def test_mentions_meet_by_first_words(spark):
    """Against all pairs of terms and texts."""
    from tracewright.functions.text import mentions
    from tracewright.operators import gaps

    terms = ["Member", "member name", "C++", "loan", "bus", "class", "box", "e-mail", "100%", "Ünit", "the desk", "- dash", "a.b c", "glass door"]
    texts = ["Members pay", "the member\nnames", "member-name", "remember", "we use c++ here", "LOANS, boxes and buses", "classes glasses", "an E-Mail e-mails", "100% of", "ünits", "desk the  desks", "dash", "a.b c", "glass-doors", "", None]
    t = spark.createDataFrame([("r", x, i % 2 == 0) for i, x in enumerate(terms)], "run_id string, term string, plural boolean")
    x = spark.createDataFrame([("r", i, y) for i, y in enumerate(texts)] + [("other", 99, "Member")], "run_id string, i int, text string")
    got = {(y.term, y.i) for y in gaps.mentioned(t, "term", x, "text", plural=F.col("plural")).collect()}
    said = F.when(F.col("plural"), mentions(F.col("term"), F.col("text"))).otherwise(mentions(F.col("term"), F.col("text"), plural=False))
    want = {(y.term, y.i) for y in t.join(x, "run_id").where(said).collect()}
    assert got == want and len(want) > 10


def test_terms_of_one_first_word_meet_few_texts(spark):
    """Terms that share their first words aren't all tried on each text that holds these."""
    from tracewright.functions.text import mention_grams, mention_key, mentions
    from tracewright.operators import gaps

    t = spark.range(200).selectExpr("'r' as run_id", "concat('Supplier  ', id) as term", "true as plural")
    long = [("r", x, True) for x in ("the glass-door of the hall", "the glass-door of a hall", "the glass", "the glass box", "the R&D box", "supplier")]
    t = t.unionByName(spark.createDataFrame(long, "run_id string, term string, plural boolean"))
    x = spark.range(60).selectExpr("'r' as run_id", "cast(id as int) as i", "concat('orders go to supplier-', id * 7, if(id % 3 = 0, 's, the glass door of the halls', if(id % 3 = 1, '; the glasses, the R&D boxes, the glass', ''))) as text")
    got = {(y.term, y.i) for y in gaps.mentioned(t, "term", x, "text").collect()}
    want = {(y.term, y.i) for y in t.join(x, "run_id").where(mentions(F.col("term"), F.col("text"))).collect()}
    assert got == want and {n for n, _ in want} >= {x for _, x, _ in long} - {"the glass-door of a hall", "the glass box", "supplier"}
    keyed = x.select("i", F.explode(mention_grams(F.col("text"), F.array(F.lit("supplier")))).alias("k"))
    assert t.withColumn("k", mention_key(F.col("term"))).join(keyed, "k").count() <= 2 * 60


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(4)
    base = ["member name", "Loan status", "card number", "shelf-mark", "Fines", "status", "archive box"]
    terms = {t for b in base for t in [b, b.upper(), b + "s", b.replace(" ", ""), *("".join(c for i, c in enumerate(b) if i not in r.sample(range(len(b)), k)) for k in (1, 2, 3)), b[:2] + "xy" + b[2:], b[:3] + "q" + b[4:]]}
    rows = [("r", i, t, r.choice(["field", "action"]), "w") for i, t in enumerate(sorted(terms))]
    e = spark.createDataFrame(rows, "run_id string, pos int, term string, kind string, `where` string")
    got = {(x[0], x[1], x.reason) for x in glossary.near_duplicates(e).select(F.col("a.term"), F.col("b.term"), "reason").collect()}
    a, b = e.alias("a"), e.alias("b")
    every = a.join(b, F.col("a.pos") < F.col("b.pos")).withColumn("reason", glossary.how_they_differ(F.col("a.term"), F.col("b.term"), F.col("a.kind") == F.col("b.kind")))
    assert got == {(x[0], x[1], x.reason) for x in every.where("reason is not null").select(F.col("a.term"), F.col("b.term"), "reason").collect()} and len(got) > 40


def test_usage_cents(spark):
    u = spark.createDataFrame([("m", 1000, 200, 10_000, 4000), ("m", 1000, None, None, None), ("x", 1, 1, 1, 1)], "model string, input_tokens int, output_tokens int, cache_read_input_tokens int, cache_creation_input_tokens int")
    p = spark.createDataFrame([("m", 2.0, 10.0)], "model string, input double, output double")
    got = sorted((x.input_tokens, x.cents) for x in cost.usage_cents(u, p).collect() if x.model == "m")
    assert [round(c, 9) for _, c in got] == sorted([round((1000 * 2 + 200 * 10 + 10_000 * 2 * 0.1 + 4000 * 2 * 1.25) / 1e4, 9), 0.2])
    assert cost.usage_cents(u, p).where("model = 'x'").first().cents is None
    assert "cents" in cost.usage_cents(u.select("model", "input_tokens"), p).columns


def test_cost_reports(spark):
    row = ("r", 3, 10, 1, 12_345, 1_240, 850, 11_000, 0.0812, 0.2, 0.2812, 1800.0, 0.5624)
    e = spark.createDataFrame([(*row[:1], "big", *row[1:]), (*row[:1], "tiny", *row[1:10], 0.0519, 1800.0, 0.1038)], "run_id string, model string, calls int, images int, assumed_sizes int, image_tokens int, text_tokens int, cached_tokens int, output_tokens int, input_cost double, output_cost double, total_cost double, duration double, cost_per_hour double")
    got = {x.model: x.report for x in cost.estimate_report(e, "2026-01-02").collect()}
    assert got["big"] == (
        "Estimated cost on big: $0.28 (3 model calls; 10 images \u2248 12k tokens, text \u2248 1.2k tokens, cached \u2248 850 tokens, output \u2248 11k tokens).\n"
        "That is about $0.56 per hour of recording (this one is 30:00 long).\nEstimates are rough; the real usage is printed after the run. Prices checked on 2026-01-02."
    )
    assert cost.price_comparison(e, "2026-01-02").first().report.split("\n")[1:3] == ["  tiny    $0.052  ($0.10 per hour of recording)", "  big      $0.28  ($0.56 per hour of recording)"]


def test_score_report(spark, t):
    runs = spark.createDataFrame([("a",)], "run_id string")
    key = spark.createDataFrame([("screens", 0, ["member search"], None), ("screens", 1, ["loan", "desk|counter"], None), ("screens", 2, ["nowhere", "at all"], None), ("questions", 0, ["fine"], None)], "category string, pos int, groups array<string>, screen_groups array<string>")
    from tracewright.operators import lint

    s = score.score(t, key, runs)
    text = score.report(s, score.missed(t, key, runs), score.traceability(t, runs), lint.writing_summary(lint.lint(t["requirements"], t["criteria"]))).first().report.split("\n")
    assert text[:2] == ["Category        Expected   Found  Recall  Extras", "screens                3       2    0.67       2"] and text[5] == "questions              1       1    1.00       1"
    assert text[6:11] == ["Missed:", '  screens: ["nowhere", "at all"]', "Traceability:", "  requirements without source quote: 1", "  acceptance criteria with unknown requirement: 1"]
    assert text[-1] == "Overall recall: 0.83" and text[-2].startswith("  rules seen: ")


def test_cost(spark):
    m = spark.createDataFrame([("r", float(i), "x" * 9, 1280, 720, 400 if i == 0 else None, 100 if i == 0 else None, "abc" if i == 1 else None) for i in range(9)], "run_id string, start double, text string, width int, height int, crop_width int, crop_height int, ocr string")
    tr = spark.createDataFrame([("r", "t" * 150_001)], "run_id string, transcript string")
    e = cost.tokens(m, tr, read_prompt=100, merge_prompt=40).first()
    image = 9 * 1229 + round(400 * 100 / 750)
    text = 9 * (3 + 12) + 30 + 13 + 2 * 120 + 100 + 2 * (37501 + 2400 + 60) + 40
    assert (e.calls, e.images, e.image_tokens, e.text_tokens, e.cached_tokens, e.output_tokens) == (4, 10, image, text, 140, 11000)
    p = cost.priced(cost.tokens(m, tr, 100, 40), spark.createDataFrame([("s", 1.0, 5.0)], "model string, input double, output double"), spark.createDataFrame([("r", 1800.0)], "run_id string, duration double")).first()
    assert abs(p.total_cost - ((image + text) + 14 + 55000) / 1e6) < 1e-9 and abs(p.cost_per_hour - 2 * p.total_cost) < 1e-12


def test_scenes(spark):
    rows = [("r", float(t), h, sc) for t, h, sc in [(0, "00", None), (2, "ff", 0.01), (3, "ff", 0.3), (4, "0f", 0.4), (7, "0f", 0.2), (9, "00", 0.5)]]
    rows += [("still", float(t), "00", None if t == 0 else 0.5 if t == 5 else 0.0) for t in range(25)]
    df = spark.createDataFrame(rows, "run_id string, t double, hash string, score double").repartition(3)
    got = group(keyframes.keep_scenes(df, distance=3).orderBy("run_id", "frame").collect())
    assert [(x.t, x.frame) for x in got["r"]] == [(0.0, 0), (3.0, 1), (7.0, 2), (9.0, 3)] and [x.t for x in got["still"]] == [0.0, 5.0]
    assert [x.t for x in group(keyframes.extract(df, detect="scene").collect())["still"]] == [0.0, 10.0, 20.0]
    assert sorted(x.t for x in keyframes.sampled(df, 0.25).where("run_id = 'r'").collect()) == [0.0, 4.0, 9.0]
    dark, light = np.zeros((4, 6, 3), np.uint8), np.full((4, 6, 3), 255, np.uint8)
    pics = spark.createDataFrame([("r", i, x.tobytes(), 6, 4) for i, x in enumerate((dark, dark, light))], "run_id string, index int, pixels binary, width int, height int")
    scores = [x.score for x in keyframes.brightness_change(pics).orderBy("index").collect()]
    assert scores[0] is None and scores[1] == 0 and abs(scores[2] - 1) < 1e-3


def test_restored_frames(spark):
    from tracewright.operators import boxes

    frames = spark.createDataFrame([("r", 0, b"x", 1), ("r", 1, b"y", 0)], "run_id string, index int, pixels binary, painted int")
    old = spark.createDataFrame([("r", 0, b"o"), ("q", 1, b"z")], "run_id string, index int, pixels binary")
    assert {x["index"]: (bytes(x.pixels), x.restored) for x in boxes.restore(frames, old).collect()} == {0: (b"o", True), 1: (b"y", False)}


class Answerer:
    def __call__(self, task, text, frames):
        assert "Yes, by checksum" in text and "Q1" not in text
        new = {"id": "N1", "statement": "The system must check card numbers", "rationale": None, "source_quote": "by checksum", "timestamp": 7.0, "keyframe_index": 0, "screen_id": "S99", "kind": "functional", "priority": "must", "confidence": "high"}
        return {"requirements": [new], "updates": [{"id": "R1", "statement": "New words", "reason": "it is so"}], "questions": []}


def test_resolve(spark, t, tmp_path):
    from tracewright import api

    out, done = api.resolve(t, Answerer(), str(tmp_path))
    assert [tuple(x) for x in done.collect()] == [("a", "Q2")]
    assert col(out["requirements"], "id", "screen_id")[-1] == ("R011", None)
    assert col(out["requirements"], "statement", "rationale")[0] == ("New words", "Updated after the expert's answer: it is so")
    again, still = api.resolve(out, Answerer(), str(tmp_path / "2"), done)
    assert col(again["requirements"], "id") == col(out["requirements"], "id") and still.count() == 1


def test_merge_report(spark, merged):
    m, runs = merged
    before = schema.entities(fixtures.analysis(spark, "a").unionByName(fixtures.analysis(spark, "b")))
    lines = merge.report(before, m, runs).split("\n")
    assert lines[0] == "Merged 2 runs." and lines[1].startswith("  a: 4 screens, 5 fields, 5 actions, 4 journey steps, 3 requirements,")
    assert "  screens: 8 came in, 4 kept (4 folded into an earlier one)" in lines and "  actions: 10 came in, 10 kept" in lines


def test_close_ups(spark):
    img = np.zeros((200, 400, 3), np.uint8)
    img[50:80, 100:140] = 200
    change = "change_from_previous struct<x:int,y:int,w:int,h:int,fraction:double>"
    rows = [("r", 0, img.tobytes(), 400, 200, None), ("r", 1, img.tobytes(), 400, 200, (100, 50, 40, 30, 0.01)), ("r", 2, img.tobytes(), 400, 200, (0, 0, 400, 190, 0.9)), ("r", 3, img.tobytes(), 400, 200, (0, 0, 40, 30, 0.0001))]
    df = spark.createDataFrame(rows, f"run_id string, index int, pixels binary, width int, height int, {change}")
    got = {x["index"]: x for x in keyframes.close_ups(df, pad=10).collect()}
    assert list(got) == [1] and (got[1].crop_width, got[1].crop_height) == (640, round(50 * 640 / 60))
    part = np.frombuffer(got[1].crop, np.uint8).reshape(got[1].crop_height, 640, 3)
    assert part[0, 0].max() == 0 and part[260, 300].min() == 200
    assert keyframes.close_ups(df, least=10, most=30).first().crop_width == 30
