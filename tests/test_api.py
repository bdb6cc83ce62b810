import pytest

from tests import fixtures
from tracewright import api, schema


def test_settings(tmp_path):
    f = tmp_path / "s.toml"
    f.write_text("frames_per_call = 4\nmin_gap = 2\n")
    s = api.settings(str(f), frames_per_call=6)
    assert (s["frames_per_call"], s["min_gap"], s["max_frames"]) == (6, 2, 240)
    for bad, said in (("frame_per_call = 1", "did you mean frames_per_call"), ("api_key = 'x'", "environment"), ("detect = 'x'", "one of"), ("max_frames = 0", "at least"), ("max_frames = true", "type")):
        f.write_text(bad)
        with pytest.raises(ValueError, match=said):
            api.settings(str(f))


def test_commands(spark, tmp_path):
    frames = spark.createDataFrame([("r", i, 5.0 * i) for i in range(3)], "run_id string, index int, timestamp double")
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:04.000\n<v Jo>Open the desk\n\n00:06.000 --> 00:07.000\nThen close it\n")
    made = api.run(spark, frames, str(tmp_path / "a.vtt"), "r", str(tmp_path / "out"), frames_per_call=2)
    assert made.tables["requirements"].count() == 2 and (tmp_path / "out" / "report.html").exists() and (tmp_path / "out" / "analysis.xlsx").exists()
    t = fixtures.tables(spark)
    given = spark.createDataFrame([("Q1", "Me", "answered"), ("Q7", "x", None)], "id string, answer string, status string")
    done, unknown = api.answers(t, given)
    assert done["questions"].where("id = 'Q1'").first().answer == "Me" and unknown.count() == 1
    assert api.compare(t, t).count() == 0
    s = api.scrub(t, [("Ada", "A**"), ("librarian", "l***")])
    assert s["fields"].where("id = 'F001'").first().example_value == "A**" and s["requirements"].first().statement.startswith("As a l***")
    runs = spark.createDataFrame([("a",)], "run_id string")
    key = spark.createDataFrame([("screens", 0, ["search"], None)], "category string, pos int, groups array<string>, screen_groups array<string>")
    assert api.score(t, key, runs)[1] and schema.CHOICES


def test_settings_act(spark, tmp_path):
    from tracewright.plans.session import OverBudget

    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:04.000\nOpen the desk\n")
    samples = spark.createDataFrame([("r", i / 2, "00" if i < 6 else "ff" if i < 12 else "0f") for i in range(20)], "run_id string, t double, hash string")
    kept = lambda **k: api.key_frames(samples, api.settings(**k)).count()
    fps = {"sample_fps": 4.0, "hash_distance": 3}
    assert kept(min_gap=0.5, **fps) == 3 and kept(min_gap=0.5, max_frames=2, **fps) == 2 and kept(min_gap=5.0, **fps) == 2 and kept(sample_fps=0.2) == 1
    prices = spark.createDataFrame([("m", 100.0, 500.0)], "model string, input double, output double")
    go = lambda **k: api.run(spark, samples, str(tmp_path / "a.vtt"), "r", str(tmp_path / "out"), **k)
    with pytest.raises(OverBudget):
        go(max_cost=0.01, prices=prices, **fps)
    with pytest.raises(ValueError, match="prices"):
        go(max_cost=0.01)
    times = spark.createDataFrame([("r", 0.0), ("r", 130.0), ("r", 150.0)], "run_id string, t double")
    assert [x["at"] for x in api.rounds(times, every_seconds=60.0).orderBy("round").collect()] == [130.0, 130.0, 150.0]
    px = bytes(range(48)) * 100
    frames = spark.createDataFrame([("r", 0, px, 40, 40)], "run_id string, index int, pixels binary, width int, height int")
    at = spark.createDataFrame([("r", 0, 5, 5, 20, 20)], "run_id string, keyframe_index int, x int, y int, w int, h int")
    box, blur = (bytes(api.redact(frames, at, redact_style=s).first().pixels) for s in ("box", "blur"))
    assert box != blur != px


def test_reduced_schema():
    from tracewright.plans.model import NotExpressible, reduced_schema

    spec = {
        "title": "T", "type": "object", "additionalProperties": False, "required": ["a", "gone"],
        "properties": {
            "a": {"$ref": "#/$defs/A", "description": "own"}, "b": {"anyOf": [{"type": "integer", "minimum": 1}, {"type": "null"}], "default": None, "description": "n"},
            "c": {"type": ["string", "null"], "format": "uri"}, "d": {"type": "array", "items": {"$ref": "#/$defs/A"}}, "e": {"const": "x"}, "f": {"enum": [1, 2], "type": "integer"},
            "g": {"type": "string", "format": "date-time", "enum": ["p", None]}, "h": {"type": "array"}, "i": {"type": "null"},
        },
        "$defs": {"A": {"type": "object", "title": "A", "properties": {"z": {"type": "number"}}, "required": ["z"], "description": "theirs"}},
    }
    inner = {"type": "object", "properties": {"z": {"type": "number"}}, "propertyOrdering": ["z"], "required": ["z"]}
    assert reduced_schema(spec) == {
        "type": "object", "required": ["a"], "propertyOrdering": list("abcdefghi"),
        "properties": {
            "a": inner | {"description": "own"}, "b": {"type": "integer", "minimum": 1, "nullable": True, "description": "n"}, "c": {"type": "string", "nullable": True},
            "d": {"type": "array", "items": inner | {"description": "theirs"}}, "e": {"type": "string", "enum": ["x"]}, "f": {"type": "integer"},
            "g": {"type": "string", "format": "date-time", "enum": ["p"], "nullable": True}, "h": {"type": "array", "items": {"type": "string"}}, "i": {"type": "string", "nullable": True},
        },
    }
    for bad in ({"$ref": "#/x/A"}, {"$ref": "#/$defs/B"}, {"anyOf": [{"type": "string"}, {"type": "integer"}]}, {"$ref": "#/$defs/R", "$defs": {"R": {"type": "object", "properties": {"r": {"$ref": "#/$defs/R"}}}}}):
        with pytest.raises(NotExpressible):
            reduced_schema(bad)
