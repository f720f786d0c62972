"""Recordings out and in again: nothing may change."""
import json
import os
import tempfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clickloom import model
from clickloom.plans.ordered import CHUNK
from clickloom.sources import documents
from clickloom.sources.documents import DocumentWriter, joint, read_documents, write_documents
from clickloom.sources.recordings import assemble_recordings, load_documents, read_recordings, recording_envelopes, recording_events

ENVELOPE = "rec_id string, version string, surface string, started_at string, ended_at string, metadata {}, notes {}".format(
    model.METADATA.simpleString(), model.RECORDING["notes"].dataType.simpleString())
EVENT = ("rec_id string, ord long, id string, ts_ms long, surface string, type string, value_json string, target {}, screenshot_path string, "
         "viewport {}, redacted boolean, notes string").format(model.TARGET.simpleString(), model.VIEWPORT.simpleString())
NAMES = ["plain", "with space & 100%", "a/b+c", "ünï", "empty", "hot", "noted"]
VALUES = [None, '"typed \\"text\\"\\n"', "12.5", '{"z":1,"a":[true,null]}', "true", "[]", '"é"']


def target(i):
    selectors = None if i % 5 == 0 else (None, f"//x[{i}]", None, "línea\n2" if i % 2 else None, None, "button::Go")
    return (selectors, ["f1", "f2"] if i % 3 else [], [], f"https://x.test/{i}?q=\"1\"", (1, 2, 3, i) if i % 4 == 0 else None, None, "win", None)


def event(rec, i):
    viewport = None if i % 3 else (800, 600, 1.5, 1.0)
    return (rec, i, f"e{i}", 10**12 + 7 * i, "desktop", model.EVENT_TYPES[i % 20], VALUES[i % 7], target(i), None if i % 2 else f"screenshots/{i}.png",
            viewport, i % 4 == 1, "note \\ here" if i % 6 == 0 else None)


def envelopes():
    out = []
    for k, name in enumerate(NAMES):
        metadata = None if name == "plain" else ("BeOS", None, (640, 480, 2.0, 1.0) if k % 2 else None, 'say "hi"\n')
        notes = [(i, f"n{i} – \t") for i in range(300 if name == "noted" else k)]
        out.append((name, "1.0", "desktop", "2031-01-01T00:00:00Z", "2031-01-01T00:01:00.5Z", metadata, notes))
    return out


def events():
    counts = {"plain": 3, "with space & 100%": 1, "a/b+c": 12, "ünï": 2, "hot": 700, "noted": 2}
    return [event(n, i) for n, c in counts.items() for i in range(1, c + 1)]


def plain(rows):
    return sorted((json.dumps(r.asDict(recursive=True), sort_keys=True) for r in rows))


@pytest.fixture
def many_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_load_write_load(spark, many_partitions):
    root = tempfile.mkdtemp(prefix="docs-") + "/set"
    ev, env = spark.createDataFrame(events(), EVENT), spark.createDataFrame(envelopes(), ENVELOPE)
    write_documents(ev, env, root)
    folders = [n for n in os.listdir(root) if not n.startswith(".")]
    assert len(folders) == len(NAMES) + 1 and documents.MARKER in folders  # no part is left
    for folder in set(folders) - {documents.MARKER}:
        assert os.listdir(f"{root}/{folder}") == ["recording.json"]
        json.load(open(f"{root}/{folder}/recording.json"))
    docs = read_documents(spark, root)
    assert plain(recording_envelopes(docs).drop("n_events").collect()) == plain(env.collect())
    got = recording_events(docs, chunk_rows=50)
    assert CHUNK in got.columns  # a recording above chunk_rows
    assert plain(got.select(ev.columns).collect()) == plain(ev.collect())
    # and once more, from what was loaded
    again = tempfile.mkdtemp(prefix="docs-") + "/set"
    write_documents(got, recording_envelopes(docs), again)
    twice = read_documents(spark, again)
    assert plain(recording_events(twice).select(ev.columns).collect()) == plain(ev.collect())
    assert plain(recording_envelopes(twice).collect()) == plain(recording_envelopes(docs).collect())


def test_a_hot_recording_goes_through_many_tasks(spark, many_partitions, monkeypatch):
    ev = spark.createDataFrame([event("hot", i) for i in range(1, 2001)], EVENT)
    rows = documents.fragments(ev, spark.createDataFrame([e for e in envelopes() if e[0] == "hot"], ENVELOPE))
    parts = rows.repartitionByRange("rec", "section", "pos").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 8 and max(r["count"] for r in parts) < 600


def test_an_attempt_that_runs_twice_changes_nothing(spark):
    root = tempfile.mkdtemp(prefix="docs-")
    rows = pa.record_batch({"rec": ["a", "a", "a", "b", "c"], "section": pa.array([0, 2, 2, 0, 0], pa.int32()), "pos": [0, 1, 2, 0, 0],
                            "text": ['{"version":"1.0"', '{"id":"1"}', '{"id":"2"}', '{"version":"1.0"', '{"version":"1.0"']})
    writer = DocumentWriter(root, "job")
    first = writer.write(iter([rows]))
    before = open(f"{root}/a/recording.json").read()
    second = writer.write(iter([rows]))
    assert open(f"{root}/a/recording.json").read() == before and json.loads(before)["events"] == [{"id": "1"}, {"id": "2"}]
    assert first.documents == second.documents == 2 and [p["rec"] for p in first.pieces] == ["c"]
    assert not os.path.exists(f"{root}/c/recording.json")
    writer.abort([first, second])
    assert not os.path.exists(f"{root}/_parts/job")


def test_unfinished_and_full_folders(spark):
    root = tempfile.mkdtemp(prefix="docs-")
    with pytest.raises(FileNotFoundError):
        read_documents(spark, root)
    ev, env = spark.createDataFrame(events()[:3], EVENT), spark.createDataFrame(envelopes()[:2], ENVELOPE)
    write_documents(ev, env, root)
    with pytest.raises(FileExistsError):
        write_documents(ev, env, root)
    write_documents(ev, env.limit(1), root, overwrite=True)
    assert [r["rec_id"] for r in read_documents(spark, root).collect()] == ["plain"]
    none = tempfile.mkdtemp(prefix="docs-")
    write_documents(ev, env.limit(0), none)
    assert os.path.exists(f"{none}/{documents.MARKER}")


def test_joints():
    whole = '{"v":1' + joint(0, 1) + '{"n":1}' + joint(1, 1) + '{"n":2}' + joint(1, 2) + '{"e":1}' + joint(2, 2) + '{"e":2}' + joint(2, None)
    assert json.loads(whole) == {"v": 1, "notes": [{"n": 1}, {"n": 2}], "events": [{"e": 1}, {"e": 2}]}
    assert json.loads('{"v":1' + joint(0, None)) == {"v": 1, "notes": [], "events": []}
    assert json.loads('{"v":1' + joint(0, 2) + "3" + joint(2, None)) == {"v": 1, "notes": [], "events": [3]}
    assert json.loads('{"v":1' + joint(0, 1) + "3" + joint(1, None)) == {"v": 1, "notes": [3], "events": []}
    for pair in ((0, 0), (2, 0), (2, 1)):
        with pytest.raises(ValueError):
            joint(*pair)


def test_documents_of_recorders(spark):
    """As recorders write them: unknown fields, values of any kind, key order."""
    root = tempfile.mkdtemp(prefix="recs-")
    doc = {"surface": "desktop", "started_at": "2029-09-09T09:09:09Z", "ended_at": "2029-09-09T09:10:00Z", "events": [
        {"id": "p", "ts_ms": 3, "surface": "desktop", "type": "drag", "value": {"to": [4, 5], "from": [1, 2]}, "later": {"x": 1}, "screenshot_path": "s/p.png"},
        {"id": "q", "ts_ms": 9, "surface": "desktop", "type": "clipboard", "value": "copied"}]}
    os.makedirs(f"{root}/board")
    with open(f"{root}/board/recording.json", "w") as f:
        json.dump(doc, f)
    a, b = read_recordings(spark, f"{root}/*/recording.json").orderBy("ord").collect()
    assert (a["rec_id"], a["type"], b["type"]) == ("board", "drag", "clipboard")
    assert list(json.loads(a["value_json"])) == ["to", "from"] and b["value_json"] == '"copied"'
    assert a["screenshot_path"] == "s/p.png" and a["redacted"] is False
    assert load_documents(spark, f"{root}/*/recording.json").first()["metadata"] is None


def test_assembling(spark):
    ev = spark.createDataFrame(events()[:3], EVENT)
    bare = assemble_recordings(ev).first()
    assert (bare["version"], bare["surface"], bare["n_events"], bare["first_id"], bare["last_id"]) == ("1.0", "desktop", 3, "e1", "e3")
    assert bare["started_at"] == "2001-09-09T01:46:40.007Z" and bare["notes"] == [] and bare["metadata"] is None
    sessions = spark.createDataFrame([("plain", "browser", "s", "e", ("os", None, None, "h")), ("silent", "browser", "s", "e", None)],
                                     "rec_id string, surface string, started_at string, ended_at string, metadata " + model.METADATA.simpleString())
    notes = spark.createDataFrame([("plain", 9, "late"), ("plain", 2, "early"), ("silent", 1, "only")], "rec_id string, ts_ms long, text string")
    got = {r["rec_id"]: r for r in assemble_recordings(ev, sessions, notes).collect()}
    assert got["plain"]["surface"] == "browser" and got["plain"]["started_at"] == "s" and got["plain"]["metadata"]["user_intent_hint"] == "h"
    assert [n["text"] for n in got["plain"]["notes"]] == ["early", "late"]
    assert got["silent"]["n_events"] == 0 and [n["text"] for n in got["silent"]["notes"]] == ["only"]
