"""JSON against shapes with rules: every wrong place is named."""
import copy
import json

import pytest
from pyspark.sql import functions as F, types as T

from clickloom import model
from clickloom.functions import shapes
from clickloom.operators.normalize import schema_problems, validate_documents

GOOD = {
    "version": "1.0", "surface": "desktop", "started_at": "2030-01-01T00:00:00Z", "ended_at": 1893456000, "metadata": {"os": None, "viewport": {"w": 1, "h": "2"}},
    "events": [{"id": "a", "ts_ms": 1, "surface": "desktop", "type": "click", "value": [{"any": None}], "redacted": 0,
                "target": {"selector_alternatives": {"css": None}, "frame_path": ["x"], "viewport_box": None, "unknown": 5}, "viewport": {"w": 3.0, "h": 4, "dpr": "1.5"}},
               {"id": "b", "ts_ms": "12", "surface": "browser", "type": "key", "target": {"viewport_box": {"x": 1, "y": 2, "w": 3, "h": True}}, "notes": None}],
    "notes": [{"ts_ms": 5, "text": ""}], "later": 1}

BAD = [
    ("version", 1, "version: not a string"), ("surface", "phone", "surface: not one of browser, desktop"), ("surface", None, "surface: null"),
    ("started_at", "soon", "started_at: not a time"), ("ended_at", [], "ended_at: not a time"), ("metadata", None, "metadata: null"), ("metadata", 3, "metadata: not an object"),
    ("metadata.os", 5, "metadata.os: not a string"), ("metadata.viewport", {"w": 1}, "metadata.viewport.h: missing"), ("metadata.viewport.w", 1.5, "metadata.viewport.w: not an integer"),
    ("events", {}, "events: not an array"), ("events", None, "events: null"), ("events.1", 4, "events.1: not an object"), ("events.0", None, "events.0: null"),
    ("events.1.target.viewport_box.w", "wide", "events.1.target.viewport_box.w: not an integer"), ("events.0.target.url", 5, "events.0.target.url: not a string"),
    ("events.0.target.frame_path", "top", "events.0.target.frame_path: not an array"), ("events.0.target.frame_path", ["a", None], "events.0.target.frame_path.1: null"),
    ("events.0.target.shadow_path", ["a", {}], "events.0.target.shadow_path.1: not a string"), ("events.0.target", None, "events.0.target: null"),
    ("events.0.target.selector_alternatives", None, "events.0.target.selector_alternatives: null"), ("events.0.target.selector_alternatives.css", [1], "events.0.target.selector_alternatives.css: not a string"),
    ("events.0.viewport.dpr", "wide", "events.0.viewport.dpr: not a number"), ("events.0.viewport.dpr", None, "events.0.viewport.dpr: null"),
    ("events.0.redacted", "maybe", "events.0.redacted: not a boolean"), ("events.0.redacted", 2, "events.0.redacted: not a boolean"),
    ("events.0.type", "wave", "events.0.type: not one of " + ", ".join(model.EVENT_TYPES)), ("events.0.id", 7, "events.0.id: not a string"),
    ("events.1.ts_ms", 1.5, "events.1.ts_ms: not an integer"), ("events.1.ts_ms", "1.5", "events.1.ts_ms: not an integer"), ("events.1.screenshot_path", 4, "events.1.screenshot_path: not a string"),
    ("notes.0.text", None, "notes.0.text: null"), ("notes.0", {"text": "t"}, "notes.0.ts_ms: missing"), ("notes", "t", "notes: not an array")]


def changed(path, value):
    doc = copy.deepcopy(GOOD)
    at = doc
    *way, last = path.split(".")
    for k in way:
        at = at[int(k) if isinstance(at, list) else k]
    at[int(last) if isinstance(at, list) else last] = value
    return doc


def test_every_wrong_field_is_named_with_its_path(spark):
    rows = [(-1, json.dumps(GOOD), "")] + [(i, json.dumps(changed(p, v)), want) for i, (p, v, want) in enumerate(BAD)]
    rows += [(900, "[1]", ": not a JSON object"), (901, "torn", ": not a JSON object"), (902, None, ": not a JSON object"), (903, "null", ": not a JSON object")]
    rows += [(950, "{}", "surface: missing; started_at: missing; ended_at: missing")]
    got = validate_documents(spark.createDataFrame(rows, "i int, body string, want string")).withColumn("told", shapes.told(F.col("problems")))
    for r in got.collect():
        assert r["told"] == r["want"], r["i"]
        assert r["valid"] == (r["want"] == "")


def test_many_problems_are_rows(spark):
    doc = changed("events.0.target", {"url": 1, "app_name": 2})
    doc["notes"] = [{}, {"ts_ms": None, "text": 3}]
    df = spark.createDataFrame([("r", json.dumps(doc)), ("ok", json.dumps(GOOD))], "rec_id string, body string")
    assert sorted(tuple(r) for r in schema_problems(df).collect()) == sorted([
        ("r", "events.0.target.url", "not a string"), ("r", "events.0.target.app_name", "not a string"), ("r", "notes.0.ts_ms", "missing"),
        ("r", "notes.0.text", "missing"), ("r", "notes.1.ts_ms", "null"), ("r", "notes.1.text", "not a string")])


def test_closed_objects(spark):
    shape = T.StructType([model.ruled("a", T.LongType(), required=True), model.ruled("b", T.StructType([model.ruled("c", T.VariantType())]), closed=True)])
    df = spark.createDataFrame([('{"a": 1, "z": 2, "b": {"c": 1, "d": 2}}',)], "j string")
    told = lambda closed: df.select(shapes.told(shapes.problems(F.parse_json("j"), shape, closed=closed))).first()[0]
    assert told(False) == "b.d: unknown key" and told(True) == "b.d: unknown key; z: unknown key"


@pytest.mark.parametrize("field,value,error", [
    ("goal", None, "steps.1.goal: null"), ("index", "x", "steps.1.index: not an integer"), ("source_event_ids", ["e", 4], "steps.1.source_event_ids.1: not a string")])
def test_steps_of_drafts(spark, field, value, error):
    from clickloom.operators.labels import parse_drafts
    step = {"index": 1, "title": "t", "goal": "g", "action": "a", "expected_result": "e", "fallback": None, "screenshot_path": None, "source_event_ids": []}
    draft = {k: [] for k in model.DRAFT_REQUIRED_KEYS} | {"name": "n", "description": "d", "title": "t", "high_level_approach": "h", "steps": [step, {**step, field: value}]}
    lost = {**draft, "steps": [{k: v for k, v in step.items() if k != field}]}
    rows = [(0, json.dumps(draft)), (1, json.dumps(lost)), (2, json.dumps({**draft, "steps": [step]}))]
    a, b, c = parse_drafts(spark.createDataFrame(rows, "i int, result string").withColumn("surface", F.lit("desktop"))).orderBy("i").collect()
    assert a["error"] == error and a["draft"] is None and c["error"] is None and c["draft"]["steps"][0]["goal"] == "g"
    assert b["error"] == (None if field == "source_event_ids" else f"steps.0.{field}: missing")
