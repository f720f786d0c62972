import random
import re

from conftest import make_events
from pyspark.sql import functions as F

from clickloom import model
from clickloom.operators.redact import redaction_log, scrub_events, scrub_leaves


def _scrub(spark, values, chunk_rows=1 << 20):
    ev = make_events(spark, [{"ts_ms": i, "type": "input", "value": v} for i, v in enumerate(values)], chunk_rows)
    return scrub_events(ev).orderBy("ord").collect()


def test_kinds_are_numbered_apart(spark):
    a, b = _scrub(spark, ["mail kim+x@post.example.org, or +44 207 946 0958", "ssn 321-54-9876 kim+x@post.example.org"])
    assert a["value_json"] == '"mail <EMAIL_1>, or <PHONE_1>"' and a["redacted"]
    assert b["value_json"] == '"ssn <SSN_1> <EMAIL_2>"'  # an equal value gets a new number


def test_nested_values_change_and_keys_stay(spark):
    import json
    token = "ghp_" + "Z9" * 18
    v = {"list": [1, {"deep": f"use {token}"}], token: None, "n": 4.5, "ok": "plain"}
    r = _scrub(spark, [v])[0]
    assert json.loads(r["value_json"]) == {"list": [1, {"deep": "use <GITHUB_PAT_1>"}], token: None, "n": 4.5, "ok": "plain"}


def test_nothing_to_hide(spark):
    rows = _scrub(spark, ["call me maybe", "12345", "", None, {"x": 1}, 7])
    assert not any(r["redacted"] for r in rows)
    assert [r["value_json"] for r in rows] == ['"call me maybe"', '"12345"', '""', None, '{"x": 1}', "7"]


def test_malformed_json_stays(spark):
    from clickloom.operators.redact import scrub_events
    ev = make_events(spark, [{"ts_ms": 1, "type": "input", "value": "me@here.org"}], None).withColumn("value_json", F.lit('{"a": "me@here.org"'))
    assert scrub_events(ev).first()["value_json"] == '{"a": "me@here.org"'


def fold(texts):
    """Sequential statement of the numbering: counters per kind across texts."""
    counters, out, log = {}, [], []
    for i, t in enumerate(texts):
        for kind, pat in model.REDACTION_PATTERNS:
            def sub(m, kind=kind):
                counters[kind] = counters.get(kind, 0) + 1
                log.append((i, kind, counters[kind], len(m.group(0))))
                return f"<{kind}_{counters[kind]}>"
            t = re.sub(pat, sub, t)
        out.append(t)
    return out, log


def test_numbering_matches_fold_across_chunks(spark):
    rnd = random.Random(5)
    pieces = ["a@b.co", "x.y@mail.org", "+1 555 123 4567", "123-45-6789", "AKIA" + "B" * 16, "plain", "words here",
              "\ue000", "\ue007x\ue0f0", "\ue0f0\ue0f2\ue0f1"]
    texts = [" ".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 5))) for _ in range(40)]
    want, want_log = fold(texts)
    df = spark.createDataFrame([(1, i + 1, 0, f"d{i}", t) for i, t in enumerate(texts)],
                               "rec_id bigint, ord bigint, leaf bigint, id string, text string")
    for chunk in (3, 1 << 20, None):
        d = df if chunk is None else df.withColumn("_chunk", F.expr(f"ord div {chunk}"))
        s = scrub_leaves(d, "text")
        got = [r["scrubbed"] for r in s.orderBy("ord").collect()]
        assert got == want
        lg = redaction_log(s).orderBy("ord", "leaf", "kind_idx", "pos").collect()
        assert [(r["ord"] - 1, r["kind"], int(r["placeholder"].rsplit("_", 1)[1][:-1]), r["original_length"]) for r in lg] == want_log


def deep(rnd, depth, texts):
    """A random JSON text up to ``depth`` deep, in odd spacing, and its string leaves in order."""
    import json
    pad = lambda: rnd.choice(["", " ", "\n  ", "\t"])
    kind = rnd.randrange(7) if depth else rnd.randrange(4)
    if kind < 3:
        t = rnd.choice(texts)
        return json.dumps(t, ensure_ascii=rnd.random() < 0.5), [t]
    if kind == 3:
        return rnd.choice(["1.50", "-0", "1e5", "12345678901234567890", "true", "null"]), []
    parts, leaves = [], []
    for i in range(rnd.randrange(4)):
        x, found = deep(rnd, depth - 1, texts)
        key = json.dumps(rnd.choice(['k', 'a "quoted" key: x', "k@mail.org", "\\"]) + str(i)) + pad() + ":" + pad() if kind > 4 else ""
        parts.append(pad() + key + x + pad())
        leaves += found
    return ("{" if kind > 4 else "[") + ",".join(parts) + ("}" if kind > 4 else "]"), leaves


def test_values_of_any_depth_match_a_walk(spark):
    """Depth 5; replaced leaves hold the fold's placeholders, everything else is the same text."""
    import json
    rnd = random.Random(8)
    texts = ["plain", "", "a@b.co", 'say "x@y.org": \\', "tab\té 🙂", "ssn 321-54-9876", "key:", "\\", "}{][,:", "call +44 207 946 0958 or a@b.co"]
    values, leaves = [], []
    while len(values) < 120:
        v, found = deep(rnd, 5, texts)
        if v[0] in "[{":
            values.append(v)
            leaves.append(found)
    flat, _ = fold([t for found in leaves for t in found])
    ev = make_events(spark, [{"ts_ms": i, "type": "input"} for i in range(len(values))], None)
    raw = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "ord long, raw string")
    ev = ev.drop("value_json").join(raw, "ord").withColumnRenamed("raw", "value_json").select(ev.columns)
    out = scrub_events(ev)
    assert "Python" not in out._jdf.queryExecution().toString()
    at = 0

    def walk(o):
        nonlocal at
        if isinstance(o, str):
            at += 1
            return flat[at - 1]
        if isinstance(o, dict):
            return {k: walk(x) for k, x in o.items()}
        return [walk(x) for x in o] if isinstance(o, list) else o

    for v, found, r in zip(values, leaves, out.orderBy("ord").collect()):
        start = at
        want = walk(json.loads(v))
        assert json.loads(r["value_json"]) == want
        assert r["redacted"] == (flat[start:at] != found)
        if not r["redacted"]:
            assert r["value_json"] == v
        else:  # numbers and spacing outside the literals
            literal = r'"(?:[^"\\]|\\.)*"'
            assert re.split(literal, r["value_json"]) == re.split(literal, v)


def test_very_long_literals(spark):
    import json
    v = {"t": 'line "x"\n' * 60_000 + " me@here.org", "u": ["z" * 500_000]}
    r = _scrub(spark, [v])[0]
    assert json.loads(r["value_json"]) == {**v, "t": v["t"].replace("me@here.org", "<EMAIL_1>")}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_matches_stays_above_the_deal_and_repeats_no_step(spark):
    from clickloom.operators.redact import detect
    texts = spark.createDataFrame([(1, "call +44 207 946 0958"), (2, "none")], "doc_id long, text string")
    found = detect(texts.repartition(3), until="PHONE").filter("n_PHONE > 0")
    plan = _plan(found)
    assert plan.count("regexp_extract_all") == 8  # one a pattern
    assert plan.index("Filter") < plan.index("Repartition")
    assert [(r["doc_id"], r["len_PHONE"]) for r in found.collect()] == [(1, [16])]


def test_placeholders_repeat_no_step_below_a_filter(spark):
    texts = spark.createDataFrame([(1, 1, 0, "123-45-6789 a@b.co"), (1, 2, 0, "none")], "rec_id long, ord long, leaf long, text string")
    changed = scrub_leaves(texts).filter("scrubbed <> text")
    assert _plan(changed).count("split(") <= 2 * 9
    assert [r["scrubbed"] for r in changed.collect()] == ["<SSN_1> <EMAIL_1>"]
