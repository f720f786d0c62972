import json

from pyspark.sql import functions as F

from clickloom.sources.payloads import admission, payload_events, quarantine, screenshot_blobs

OK_ORIGIN = "chrome-extension://abc"


def _payload(events, surface="browser", **extra):
    d = {"version": "1.0", "surface": surface, "started_at": "2026-04-26T10:00:00Z",
         "ended_at": "2026-04-26T10:00:30Z", "events": events}
    d.update(extra)
    return json.dumps(d)


def _admit(spark, rows):
    df = spark.createDataFrame([(i, p, o, b) for i, (p, o, b) in enumerate(rows)],
                               "page_id bigint, path string, origin string, body string")
    df = df.withColumn("content_length", F.octet_length("body").cast("long"))
    return admission(df)


def test_statuses(spark):
    ev = {"id": "evt_in_1", "ts_ms": 1714125600000, "type": "click", "target": {"url": "https://a.test"},
          "screenshot_data": "iVBORw0KGgo="}
    rows = [
        ("/recordings", OK_ORIGIN, _payload([ev])),                       # 201
        ("/recordings", "https://evil.example", _payload([ev])),          # 403
        ("/other", OK_ORIGIN, _payload([ev])),                            # 404
        ("/recordings", OK_ORIGIN, ""),                                   # 400 empty
        ("/recordings", OK_ORIGIN, "{not json"),                          # 400 invalid
        ("/recordings", OK_ORIGIN, json.dumps({"surface": "browser", "events": {"a": 1}})),  # 422
        ("/recordings", OK_ORIGIN, _payload([dict(ev, screenshot_data="abcde")])),           # 422 base64
        ("/recordings", OK_ORIGIN, _payload([ev], surface="desktop")),                       # 422 surface
        ("/recordings", OK_ORIGIN, "[1, 2]"),                                                 # 500
    ]
    got = [r["status"] for r in _admit(spark, rows).orderBy("page_id").collect()]
    assert got == [201, 403, 404, 400, 400, 422, 422, 422, 500]


def test_accepted_events_renumbered_and_screenshots_named(spark):
    evs = [{"id": "evt_in_1", "ts_ms": 1714125600000.9, "type": "click", "target": {"url": "https://a.test"},
            "screenshot_data": "iVBORw0KGgo="},
           {"id": "evt_in_2", "ts_ms": 1714125601000, "type": "input", "value": "x", "surface": "browser"}]
    acc, quar = quarantine(_admit(spark, [("/recordings", OK_ORIGIN, _payload(evs))]))
    assert quar.count() == 0
    ev = payload_events(acc).orderBy("ord").collect()
    assert [e["id"] for e in ev] == ["evt_0001", "evt_0002"]
    assert ev[0]["ts_ms"] == 1714125600000 and ev[0]["surface"] == "browser"
    assert ev[0]["screenshot_path"] == "screenshots/evt_in_1.png"
    blobs = screenshot_blobs(payload_events(acc)).collect()
    assert len(blobs) == 1 and bytes(blobs[0]["bytes"])[:4] == b"\x89PNG"


def test_archives_are_opened_once(spark, tmp_path):
    from clickloom.sources.payloads import read_archive_documents, read_archives, write_archives
    body = '{"surface": "browser", "started_at": "2024-04-26T10:00:00Z", "ended_at": "2024-04-26T10:05:00Z", "events": [{"id": "a", "ts_ms": 1, "type": "click", "target": {"url": "u"}}]}'
    write_archives(spark.createDataFrame([("1", body), ("2", None), ("3", "[]")], "name string, body string"), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1.zip", "2.zip", "3.zip"]
    events, rejected = read_archives(spark, f"{tmp_path}/*.zip")
    docs, _ = read_archive_documents(spark, f"{tmp_path}/*.zip")
    for df in (events, rejected, docs):
        assert "MapInPandas" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r["id"] for r in events.collect()] == ["evt_0001"] and docs.count() == 1
    assert sorted((r["file"][-5:], r["status"]) for r in rejected.collect()) == [("2.zip", 400), ("3.zip", 500)]
