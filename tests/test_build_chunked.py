"""The build flow on the path for hot recordings: what its stages hold, and the same rows as without chunks."""

import json
import random

from conftest import make_events

from clickloom.operators.compact import compress
from clickloom.operators.redact import scrub_events
from clickloom.operators.segment import segment
from clickloom.plans import ordered
from clickloom.plans.build import build_summaries


def _visit(rnd, n, recs=3):
    token = "aB3dE6gH9jK2mN5pQ8rS1tU4"
    values = [None, None, {"key": "a"}, {"key": "b", "action": "press"}, {"key": "enter"}, "plain words here", "x" * 40, 12, "me@here.org",
              {"note": ["call +1 555 123 4567", {"deep": "123-45-6789 me@here.org"}]}, token, {"kind": "form_submit"}, 'quote " me@here.org']
    kinds = {"key": ["key"], "kind": ["annotation"]}
    rows = []
    for rec in range(recs):
        t = 0
        for _ in range(n):
            t += rnd.choice([50, 400, 2000])
            v = rnd.choice(values)
            known = next((kinds[k] for k in kinds if isinstance(v, dict) and k in v), ["input", "scroll", "click", "navigate"])
            rows.append({"rec_id": rec, "ts_ms": t, "type": rnd.choice(known), "value": v, "url": rnd.choice(["u1", "u2"]),
                         "screenshot_path": rnd.choice([None, "", "s/1.png"])})
    return rows


def _rows(df):
    return [r.asDict(recursive=True) for r in df.select(*sorted(c for c in df.columns if c != ordered.CHUNK)).orderBy("rec_id", "ord").collect()]


def test_stages_hold_what_their_steps_read(spark, monkeypatch):
    staged, deals = [], []
    stage, repartition = ordered.stage, type(spark.range(0)).repartition

    def watched(df, *args, **kw):
        out = stage(df, *args, **kw)
        staged.append((out.count(), set(out.columns)))
        return out

    for where in (ordered, __import__("clickloom.operators.redact", fromlist=["stage"])):
        monkeypatch.setattr(where, "stage", watched, raising=False)
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, *a: deals.append(a) or repartition(self, *a))
    rows = [{"ts_ms": 100 * i, "type": "click", "value": f"word {i % 7}"} for i in range(60)]
    rows[20]["value"] = rows[41]["value"] = "me@here.org"
    build_summaries(make_events(spark, rows, 8), gap_ms=1500)
    numbered = [n for n, cols in staged if "__t" in cols]
    assert numbered == [2]  # not all 60 events
    assert not any(cols & {"viewport", "notes", "surface", "reasons"} for _, cols in staged)
    assert sum(ordered.CHUNK in str(a) for a in deals) == 2  # all events are dealt out once, and the two leaves


def test_scrub_in_chunks_leaves_nothing_out(spark):
    rows = _visit(random.Random(21), 60)
    want = _rows(scrub_events(make_events(spark, rows, None)))
    assert sum(r["redacted"] for r in want) > 20
    for chunk in (1, 5, 1 << 20):
        assert _rows(scrub_events(make_events(spark, rows, chunk))) == want, chunk


def test_scrub_in_chunks_sees_secrets_behind_escapes(spark):
    texts = ['"me\\u0040here.org"', '{"a": "\\u0041KIA' + "B" * 16 + '"}', '["7\\u0031\\u0032-45-6789"]', '{"k": "12\\u0033-45-6789"}', '"\\"' + "aB3dE6gH9jK2mN5pQ8rS1tU4" + '"',
             '"' + "aB3dE6gH9jK2mN5pQ8rS1tU4" + '"', '["' + "aB3dE6gH9jK2mN5pQ8rS1tU4" + '", "plain"]', '"' + "٣٤٥-١٢-١٢٣٤" + '"', '{"a": "me@here.org"']
    rows = [{"ts_ms": i, "type": "input", "value": json.loads(t) if t != texts[-1] else t} for i, t in enumerate(texts)]

    def raw(df):
        from pyspark.sql import functions as F
        return df.withColumn("value_json", F.element_at(F.array(*[F.lit(t) for t in texts]), F.col("ord").cast("int")))

    want = _rows(scrub_events(raw(make_events(spark, rows, None))))
    assert sum(r["redacted"] for r in want) >= 6
    for chunk in (1, 4):
        assert _rows(scrub_events(raw(make_events(spark, rows, chunk)))) == want, chunk


def test_signals_and_segments_are_the_same_in_chunks(spark):
    rows = _visit(random.Random(22), 80)
    cols = segment(compress(make_events(spark, rows, None)), gap_ms=1500).columns
    want = _rows(segment(compress(make_events(spark, rows, None)), gap_ms=1500))
    for chunk in (1, 3, 7):
        got = segment(compress(make_events(spark, rows, chunk)), gap_ms=1500)
        assert [c for c in got.columns if c != ordered.CHUNK] == cols
        assert _rows(got) == want, chunk


def test_build_is_the_same_in_chunks(spark):
    rows = _visit(random.Random(23), 90)

    def out(chunk, **kw):
        df = build_summaries(make_events(spark, rows, chunk), gap_ms=1500, **kw)
        return [tuple(r) for r in df.orderBy("rec_id", "seg").collect()]

    for kw in ({}, {"max_segments": None}, {"max_segments": 4, "scrub": False}):
        want = out(None, **kw)
        assert len(want) > 10
        for chunk in (2, 6):
            assert out(chunk, **kw) == want, (chunk, kw)


def test_an_ord_that_repeats_is_one_event_after_scrub(spark):
    ev = make_events(spark, [{"ts_ms": i, "type": "input", "value": v} for i, v in enumerate(["plain", "me@here.org", "words"])], 2)
    twice = ev.unionByName(ev).unionByName(make_events(spark, [{"ts_ms": 9, "type": "input", "value": v} for v in ("x", "y")], 2))
    got = [(r["ord"], r["redacted"]) for r in scrub_events(twice).orderBy("ord").collect()]
    assert got == [(1, False), (2, True), (3, False)]
    nobody = scrub_events(ev.withColumn("rec_id", ev["rec_id"] + None)).orderBy("ord").collect()
    assert [r["value_json"] for r in nobody] == ['"plain"', '"<EMAIL_1>"', '"words"']
