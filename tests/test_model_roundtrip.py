import json
import os
import tempfile

from pyspark.sql import functions as F

from clickloom.operators.normalize import validate_recordings
from clickloom.operators.segment import reject_empty
from clickloom.plans.build import build_summaries
from clickloom.sources.payloads import admission, payload_events, quarantine, read_archives
from clickloom.sources.publish import publish
from clickloom.sources.recordings import load_documents, read_recordings, recording_envelopes

ORIGIN = "moz-extension://x"


def _write(docs):
    root = tempfile.mkdtemp(prefix="recs-")
    for name, doc in docs.items():
        os.makedirs(f"{root}/{name}")
        with open(f"{root}/{name}/recording.json", "w") as f:
            json.dump(doc, f)
    return root + "/*/recording.json"


def _event(i, **more):
    return {"id": f"e{i}", "ts_ms": 50 * i, "surface": "desktop", "type": "click", **more}


WHOLE = {
    "surface": "desktop", "started_at": "2030-01-02T03:04:05Z", "ended_at": "2030-01-02T03:05:00Z", "junk": 1,
    "metadata": {"os": "BeOS", "viewport": {"w": 640, "h": 480}, "user_intent_hint": "sort \"mail\""},
    "notes": [{"ts_ms": 70, "text": "now\nthis"}],
    "events": [_event(1, value={"z": 1, "a": [True, None]}, viewport={"w": 3, "h": 4, "zoom": 2.0}),
               _event(2, value=None, notes="odd", redacted=True, target={"url": "u", "frame_path": ["f"], "selector_alternatives": {"css": "b"}})],
}


def test_nothing_of_a_recording_is_lost(spark):
    glob = _write({"whole": WHOLE, "empty": {**WHOLE, "events": []}, "holed": {**WHOLE, "events": [None, _event(3)]}})
    docs = load_documents(spark, glob)
    env = {r["rec_id"]: r for r in recording_envelopes(docs).collect()}
    assert {k: r["n_events"] for k, r in env.items()} == {"whole": 2, "empty": 0, "holed": 2}
    w = env["whole"]
    assert w["version"] == "1.0" and w["started_at"] == WHOLE["started_at"] and w["ended_at"] == WHOLE["ended_at"]
    assert w["metadata"]["os"] == "BeOS" and w["metadata"]["user_intent_hint"] == 'sort "mail"'
    assert w["metadata"]["viewport"].asDict() == {"w": 640, "h": 480, "dpr": 1.0, "zoom": 1.0}
    assert [n.asDict() for n in w["notes"]] == WHOLE["notes"]
    ev = read_recordings(spark, glob)
    a, b = ev.filter("rec_id = 'whole'").orderBy("ord").collect()
    assert list(json.loads(a["value_json"]).items()) == [("z", 1), ("a", [True, None])] and b["value_json"] is None
    assert a["viewport"].asDict() == {"w": 3, "h": 4, "dpr": 1.0, "zoom": 2.0} and a["target"]["frame_path"] == []
    assert b["target"]["selector_alternatives"]["css"] == "b" and b["notes"] == "odd" and b["redacted"] and not a["redacted"]
    valid = {r["rec_id"]: r["valid"] for r in validate_recordings(ev, recording_envelopes(docs)).collect()}
    assert valid == {"whole": True, "empty": True, "holed": False}
    assert [r["rec_id"] for r in reject_empty(recording_envelopes(docs), ev).collect()] == ["empty"]


def _upload(spark, **change):
    body = {"surface": "browser", "started_at": "2031-05-05T00:00:00Z", "ended_at": "2031-05-05T00:01:00Z",
            "events": [{"id": "a/../b", "ts_ms": 10.9, "type": "input", "value": "hi", "target": {"accessible_name": "Box"}, "screenshot_data": "AAAA"},
                       {"id": "q", "ts_ms": 5000, "type": "navigate", "target": {"url": "x"}}]}
    event = change.pop("event", None)
    body.update(change)
    if event:
        body["events"][0].update(event)
    df = spark.createDataFrame([(1, "/recordings", ORIGIN, json.dumps(body))], "page_id bigint, path string, origin string, body string")
    return admission(df.withColumn("content_length", F.octet_length("body").cast("long")))


def test_the_model_decides_what_is_admitted(spark):
    status = lambda **c: _upload(spark, **c).first()["status"]
    assert status() == 201
    assert status(notes=[{"ts_ms": 1, "text": "t"}], metadata={"os": None}) == 201
    for bad in ({"started_at": "garbage"}, {"ended_at": None}, {"notes": [{"text": "t"}]}, {"notes": "t"}, {"metadata": 3},
                {"event": {"target": None}}, {"event": {"viewport": {"w": 1}}}, {"event": {"ts_ms": "1.5"}}, {"event": {"type": "wave"}},
                {"event": {"screenshot_path": 4}}, {"event": {"redacted": "maybe"}}):
        assert status(**bad) == 422, bad


def test_an_upload_feeds_the_build_flow(spark):
    ok, _ = quarantine(_upload(spark))
    ev = payload_events(ok)
    first = ev.orderBy("ord").first()
    assert first["value_json"] == '"hi"' and first["target"]["accessible_name"] == "Box" and first["ts_ms"] == 10
    assert first["screenshot_path"] == "screenshots/a_.._b.png"
    steps = build_summaries(ev.withColumnRenamed("page_id", "rec_id")).orderBy("seg").collect()
    assert [(s["seg"], s["event_count"]) for s in steps] == [(0, 1), (1, 1)]


def test_bad_archives_are_told(spark):
    import zipfile
    root = tempfile.mkdtemp(prefix="zips-")
    with open(f"{root}/torn.zip", "wb") as f:
        f.write(b"PK but no more")
    with zipfile.ZipFile(f"{root}/bare.zip", "w") as z:
        z.writestr("other.json", "{}")
    with zipfile.ZipFile(f"{root}/good.zip", "w") as z:
        z.writestr("recording.json", _upload(spark).first()["body"])
    events, rejected = read_archives(spark, root + "/*.zip")
    assert events.count() == 2
    got = {os.path.basename(r["file"]): (r["status"], r["error"]) for r in rejected.collect()}
    assert got == {"torn.zip": (422, "not a readable archive"), "bare.zip": (422, "archive has no recording.json")}


def test_publishing_twice(spark):
    root = tempfile.mkdtemp(prefix="pub-") + "/docs"
    docs = lambda *rows: spark.createDataFrame(rows, "doc bigint, scope string, name string, text string")
    actions = lambda p: [r["action"] for r in p.orderBy("doc").collect()]
    there = lambda: {(r["scope"], r["name"]): r["text"] for r in spark.read.parquet(root).collect()}
    assert actions(publish(docs((1, "user", "a", "one"), (2, "user", "a", "two"), (3, "project", "a", "three")), root)) == ["created", "conflict", "created"]
    assert actions(publish(docs((4, "user", "b", "four"), (5, "user", "a", "five")), root)) == ["created", "conflict"]
    assert there() == {("user", "a"): "one", ("project", "a"): "three", ("user", "b"): "four"}
    assert actions(publish(docs((6, "user", "a", "six"), (7, "user", "a", "seven")), root, overwrite=True)) == ["replaced", "replaced"]
    assert there() == {("user", "a"): "seven", ("project", "a"): "three", ("user", "b"): "four"}


def test_drafts_tell_what_is_wrong(spark):
    from clickloom import model
    from clickloom.operators.labels import parse_drafts
    good = {k: [] for k in model.DRAFT_REQUIRED_KEYS} | {"name": "n", "description": "d", "title": "t", "high_level_approach": "h"}
    rows = [(0, json.dumps(good)), (1, None), (2, "not json"), (3, "[1]"), (4, json.dumps({"name": "a"}))]
    out = parse_drafts(spark.createDataFrame(rows, "i bigint, result string").withColumn("surface", F.lit("desktop"))).orderBy("i").collect()
    assert out[0]["error"] is None and out[0]["draft"]["name"] == "n" and out[0]["draft"]["surface"] == "desktop"
    assert [r["draft"] for r in out[1:]] == [None] * 4
    assert out[1]["error"] == "Synthesis returned no text content" and "not a JSON object" in out[2]["error"] and "not a JSON object" in out[3]["error"]
    assert out[4]["error"].startswith("missing description, title")
