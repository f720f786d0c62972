"""Bindings of the driver tables to recording-shaped inputs.

The driver ships generic tables; these functions derive recording-shaped data
from them with Spark so that every query's work grows with the tables:

* ``rec_events`` (R0): ``events`` -> one recording per user, events in
  ``event_id`` order, typed by a fixed rule on ``props.k``.
* ``seeded_docs`` (R1): ``documents`` with one well-formed secret appended by
  ``doc_id % 9`` (recording = ``source``, order = ``doc_id``).
* ``payloads`` (R2): one upload request per ``pages`` row.
* ``responses`` (R4) / ``drafts`` (R5): model-style JSON built from
  ``conversations`` and ``labels``.

The same definitions are written as DuckDB SQL in ``clickloom.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from clickloom.functions.scalars import json_quote, ntz_millis
from clickloom.plans.ordered import CHUNK, DEFAULT_CHUNK_ROWS, add_chunk, chunk_cols, chunk_if_hot, dense_ordinal

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly if the input comes in fewer splits than there are cores."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.rdd().getNumPartitions() < n else df


def _k_type(k, et):
    return (F.when(et.isin("purchase", "signup"), "key")
            .when(et == "view", F.when(k % 4 == 0, "navigate").when(k % 4 == 1, "tab_switch")
                  .when(k % 4 == 2, "scroll").otherwise("click"))
            .when(et == "click", F.when(k % 5 == 0, "file_upload").when(k % 5 == 1, "input")
                  .otherwise("click"))
            .otherwise(F.when(k % 6 == 0, "annotation").when(k % 6 == 1, "screen_changed")
                       .when(k % 6 == 2, "dom_settled").when(k % 6 == 3, "network_idle")
                       .otherwise("scroll")))


def rec_events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R0 columns before ordering: rec_id, event_id, ts_ms, k, type, key,
    action, url, screenshot_path."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select(F.col("user_id").alias("rec_id"), "event_id", ntz_millis("ts").alias("ts_ms"),
                 k.alias("k"), "event_type")
    k, et = F.col("k"), F.col("event_type")
    is_key = et.isin("purchase", "signup")
    key = F.when(is_key, F.when(k % 10 == 0, "enter").when(k % 10 == 1, "Shift")
                 .when(k % 10 == 2, "f5").when(k % 10 == 3, "ctrl_l")
                 .otherwise(F.expr("chr(97 + k % 26)")))
    action = F.when(is_key, F.when(k % 11 == 0, "release").otherwise("press"))
    url = F.when(et != "error", F.concat(F.lit("https://app.test/p"), (k % 3).cast("string")))
    shot = F.when(et.isin("click", "view") & (k % 2 == 0),
                  F.concat(F.lit("screenshots/"), (k % 7).cast("string"), F.lit(".png")))
    return e.select("rec_id", "event_id", "ts_ms", "k", _k_type(k, et).alias("type"),
                    key.alias("key"), action.alias("action"), url.alias("url"),
                    shot.alias("screenshot_path"))


def rec_events(spark: SparkSession, sf_dir: str, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """R0 as canonical events: rec_id, ord, _chunk, id, ts_ms, surface, type,
    value_json, target, screenshot_path, viewport, redacted, notes (+ R0 columns).

    ``ord`` is a dense 1-based position by ``event_id``; ``_chunk``, a range of ``ord``,
    is there only if some recording has more than ``chunk_rows`` events."""
    r = rec_events_raw(spark, sf_dir)
    hot = chunk_if_hot(r.select("rec_id", "event_id"), "rec_id", "event_id", chunk_rows)
    if CHUNK in hot.columns:
        r = dense_ordinal(r.join(hot, ["rec_id", "event_id"]), "rec_id", "event_id", "ord")
        r = add_chunk(r.drop(CHUNK), "ord", chunk_rows)
    else:
        r = r.withColumn("ord", F.row_number().over(W.partitionBy("rec_id").orderBy("event_id")))
    value = (F.when(F.col("type") == "key",
                    F.to_json(F.struct(F.col("key").alias("key"), F.col("action").alias("action"))))
             .when(F.col("type") == "annotation", F.lit('{"kind":"form_submit"}')))
    target = F.struct(
        F.struct(*[F.lit(None).cast("string").alias(n) for n in
                   ["css", "xpath", "aria", "text", "testid", "role_name"]]).alias("selector_alternatives"),
        F.array().cast("array<string>").alias("frame_path"),
        F.array().cast("array<string>").alias("shadow_path"),
        F.col("url").alias("url"),
        F.lit(None).cast("struct<x:bigint,y:bigint,w:bigint,h:bigint>").alias("viewport_box"),
        F.lit(None).cast("string").alias("accessible_name"),
        F.lit(None).cast("string").alias("window_title"),
        F.lit(None).cast("string").alias("app_name"),
    )
    return r.select(
        "rec_id", F.col("ord").cast("long").alias("ord"), *chunk_cols(r),
        F.format_string("evt_%04d", F.col("ord")).alias("id"),
        "ts_ms", F.lit("desktop").alias("surface"), "type", value.alias("value_json"),
        target.alias("target"), "screenshot_path",
        F.lit(None).cast("struct<w:bigint,h:bigint,dpr:double,zoom:double>").alias("viewport"),
        F.lit(False).alias("redacted"), F.lit(None).cast("string").alias("notes"),
        "event_id", "k", "key", "action",
    )


# ----------------------------------------------------------------------- R3
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recorder knows of each R0 recording: surface, times, metadata; the hint is the user's first words in
    the conversation of that number."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), ntz_millis("ts").alias("ms"))
    g = e.groupBy("rec_id").agg(F.min("ms").alias("s"), F.max("ms").alias("e"))
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    hint = c.groupBy(F.col("conv_id").alias("rec_id")).agg(F.min_by("text", "turn").alias("hint"))
    iso = lambda x: F.date_format(F.timestamp_millis(x), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    rec = F.col("rec_id")
    viewport = F.struct((F.lit(1000) + rec % 7).cast("long").alias("w"), F.lit(700).cast("long").alias("h"),
                        F.when(rec % 2 == 0, 1.5).otherwise(1.0).alias("dpr"), F.lit(1.0).alias("zoom"))
    metadata = F.struct(F.lit("Linux").alias("os"), F.lit(None).cast("string").alias("browser"),
                        F.when(rec % 3 != 0, viewport).alias("viewport"), F.col("hint").alias("user_intent_hint"))
    return g.join(hint, "rec_id", "left").select("rec_id", F.lit("desktop").alias("surface"), iso(F.col("s")).alias("started_at"),
                                                 iso(F.col("e")).alias("ended_at"), metadata.alias("metadata"))


def session_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of a recording: the turns of the conversation of its number."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("ord"), (F.lit(1714125600000) + F.col("turn") * 1000).cast("long").alias("ts_ms"), "text")


# ----------------------------------------------------------------------- R1
SEED_SECRETS = [
    # (doc_id % 9) -> appended text; built from the zero-padded doc id
    (1, "AKIA{p16}"),
    (2, "ghp_{p36}"),
    (3, "sk_live_{p16}"),
    (4, "sk-ant-{p32}"),
    (5, "Bearer tok{p20}"),
    (6, "eyJ{p10}.eyJ{p10}.{p10}"),
    (7, "{p3}-{p2}-{p4}"),
]


def seed_expr(doc_id: str = "doc_id"):
    d = F.col(doc_id).cast("string")
    pads = {f"p{n}": F.lpad(d, n, "0") for n in (2, 3, 4, 10, 16, 20, 32, 36)}

    def build(tmpl: str):
        parts, rest = [], tmpl
        while rest:
            i = rest.find("{")
            if i < 0:
                parts.append(F.lit(rest)); break
            if i:
                parts.append(F.lit(rest[:i]))
            j = rest.index("}", i)
            parts.append(pads[rest[i + 1:j]])
            rest = rest[j + 1:]
        return F.concat(*parts)

    m = F.col(doc_id) % 9
    e = F.when(F.lit(False), F.lit(None))
    for r, tmpl in SEED_SECRETS:
        e = e.when(m == r, F.concat(F.lit(" "), build(tmpl)))
    return F.coalesce(e, F.lit(""))


def seeded_docs(spark: SparkSession, sf_dir: str, chunk_rows: int = 1 << 16) -> DataFrame:
    """Documents as one-event recordings: rec_id=source, ord=doc_id,
    value = text + seeded secret (JSON string)."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    text = F.concat(F.col("text"), seed_expr())
    d = d.select(F.col("source").alias("rec_id"), F.col("doc_id").alias("ord"),
                 F.col("doc_id"), text.alias("text"))
    d = chunk_if_hot(d, "rec_id", "ord", chunk_rows)
    return d.select("rec_id", "ord", *chunk_cols(d), "doc_id",
                    F.format_string("doc_%d", F.col("doc_id")).alias("id"),
                    json_quote("text").alias("value_json"), "text",
                    F.lit(False).alias("redacted"))


# ----------------------------------------------------------------------- R4
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-style label responses, one per conversation turn, with
    defects by ``conv_id % 5`` (malformed, no intent, extra key, no
    confidence); a turn has no text where ``(conv_id + turn) % 8`` is 7.
    The intent is the turn's whole text.  Confidence from ``labels``."""
    c = table(spark, sf_dir, "conversations")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), "quality", "toxic")
    x = c.join(lab, "conv_id", "left")
    intent = json_quote("text")
    conf = F.when(F.col("toxic") == 1, "low").when(F.col("quality") == 1, "high").otherwise("medium")
    m = F.col("conv_id") % 5
    t = F.col("turn").cast("string")
    q = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    resp = (F.when((F.col("conv_id") + F.col("turn")) % 8 == 7, F.lit(None).cast("string"))
            .when(m == 0, F.concat(F.lit('{"intent": '), intent))
            .when(m == 1, F.concat(F.lit('{"target_description": null, "expected_outcome": "done", "confidence": '), q(conf), F.lit("}")))
            .when(m == 2, F.concat(F.lit('{"intent": '), intent, F.lit(', "target_description": null, "expected_outcome": "done", "confidence": '),
                                   q(conf), F.lit(', "extra": 1}')))
            .when(m == 3, F.concat(F.lit('{"intent": '), intent, F.lit(', "target_description": "t'), t,
                                   F.lit('", "expected_outcome": null}')))
            .otherwise(F.concat(F.lit('{"intent": '), intent, F.lit(', "target_description": "t'), t,
                                F.lit('", "expected_outcome": "done", "confidence": '), q(conf), F.lit("}"))))
    return x.select("conv_id", "turn", F.col("turn").alias("arrival"), resp.alias("response"))


# ----------------------------------------------------------------------- R5
def draft_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5 drafts as columns: one draft per conversation, one step per turn,
    defects by ``conv_id % 6`` (0 bad name, 1 long description, 2 extra key,
    3 step without goal, 4 missing image)."""
    c = table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    step = F.struct(
        turn.alias("index"), F.col("text").alias("title"),
        F.lit("g").alias("goal"), F.lit("a").alias("action"), F.lit("e").alias("expected_result"),
        F.when(turn % 2 == 0, F.lit("retry")).alias("fallback"),
        F.when(turn % 3 == 0, F.concat(F.lit("screenshots/"), turn.cast("string"), F.lit(".png"))).alias("screenshot_path"),
        F.array(F.concat(F.lit("evt_"), turn.cast("string"))).alias("source_event_ids"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps"),
                                 F.min_by("text", turn).alias("first_text"))
    cid = F.col("conv_id")
    m = cid % 6
    return g.select(
        "conv_id",
        F.when(m == 0, F.concat(F.lit("Bad Name "), cid.cast("string"))).otherwise(
            F.concat(F.lit("skill-"), cid.cast("string"))).alias("name"),
        F.when(m == 1, F.repeat(F.lit("x"), 1100)).otherwise(F.concat(F.lit("Use when "), F.col("first_text"))).alias("description"),
        F.concat(F.lit("Skill "), cid.cast("string")).alias("title"),
        F.array(F.concat(F.lit("when "), cid.cast("string"))).alias("when_to_use"),
        F.when(cid % 2 == 0, F.array(F.lit("account"))).otherwise(F.array().cast("array<string>")).alias("prerequisites"),
        F.when(cid % 3 == 0, F.array(F.lit("file"))).otherwise(F.array().cast("array<string>")).alias("inputs"),
        F.lit("Do it").alias("high_level_approach"),
        "steps",
        F.array(F.lit("done")).alias("success_criteria"),
        F.when(cid % 4 == 0, F.array(F.lit("fails"))).otherwise(F.array().cast("array<string>")).alias("failure_modes"),
        F.when(m == 2, F.lit(1)).alias("extra"),
    )


def drafts_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5 as model result text (JSON, nulls kept), defects included."""
    d = draft_fields(spark, sf_dir)
    m = F.col("conv_id") % 6
    js = F.to_json(F.struct(*[F.col(k) for k in ["name", "description", "title", "when_to_use", "prerequisites",
                                                   "inputs", "high_level_approach", "steps", "success_criteria",
                                                   "failure_modes"]]), {"ignoreNullFields": "false"})
    js = (F.when(m == 2, F.regexp_replace(js, "^[{]", '{"extra":1,'))
          .when(m == 3, F.regexp_replace(js, '"goal":"g",', "")).otherwise(js))
    return d.select("conv_id", js.alias("result"), F.lit("browser").alias("surface"))


# ----------------------------------------------------------------------- R2
def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: one upload request per page: path/origin from the url and a JSON body with a defect chosen by
    ``page_id % 8``; where that is 5 the page's whole html is a note."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    pid = F.col("page_id")
    url = F.col("url")
    ts0 = (F.lit(1714125600000) + pid * 1000)
    started = F.lit('"started_at": "2024-04-26T10:00:00Z", "ended_at": "2024-04-26T10:05:00Z"')

    def click(eid, ts, extra):
        return F.concat(F.lit('{"id": "' + eid + '", "ts_ms": '), ts, F.lit(', "type": "click", "target": {"url": "'),
                        url, F.lit('"}'), F.lit(extra), F.lit("}"))

    def wrap(events, surface="browser", more=F.lit("")):
        return F.concat(F.lit('{"surface": "' + surface + '", '), started, more, F.lit(', "events": '), events, F.lit("}"))

    told = F.concat(F.lit(', "metadata": {"os": "Linux", "viewport": {"w": 800, "h": 600}, "user_intent_hint": '), json_quote("url"),
                    F.lit('}, "notes": [{"ts_ms": '), ts0.cast("string"), F.lit(', "text": '), json_quote("html"), F.lit("}]"))

    ev = lambda *xs: F.concat(F.lit("["), *sum([[x, F.lit(", ")] for x in xs], [])[:-1], F.lit("]"))
    m = pid % 8
    body = (F.when(m == 0, F.lit(""))
            .when(m == 1, F.lit('{"surface": "browser", "events": ['))
            .when(m == 2, wrap(F.lit("[]"), surface="desktop"))
            .when(m == 3, wrap(F.lit('{"a": 1}')))
            .when(m == 4, wrap(ev(click("evt_in_1", ts0.cast("string"), ', "screenshot_data": "abcde"'))))
            .when(m == 5, wrap(ev(click("evt_in_1", F.concat(ts0.cast("string"), F.lit(".75")), ""),
                                  click("evt_in_2", F.concat((ts0 + 1500).cast("string"), F.lit(".25")), ', "surface": "browser"')), more=told))
            .when(m == 6, wrap(ev(click("evt_in_1", ts0.cast("string"), ', "screenshot_data": "iVBORw0KGgo="'),
                                  click("evt_in_2", (ts0 + 700).cast("string"), ', "value": "typed a@b.co"')),
                               more=F.lit(', "metadata": {"browser": "x"}')))
            .otherwise(F.lit("[1, 2]")))
    path = F.when(url.contains("?"), F.lit("/upload")).otherwise(F.lit("/recordings"))
    origin = (F.when(url.startswith("https"), F.lit("chrome-extension://abc"))
              .when(url.contains("blog"), F.lit("moz-extension://def")).otherwise(F.lit("http://evil.example")))
    return p.select("page_id", path.alias("path"), origin.alias("origin"), body.alias("body"),
                    F.octet_length(body).cast("long").alias("content_length"))


# ----------------------------------------------------------------------- R6
def typed_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload per page with one field of a wrong type, or missing, by ``page_id % 12`` (0: none)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    m, html = F.col("page_id") % 12, json_quote("html")
    lit = F.lit
    target = (F.when(m == 1, '{"url": 5}').when(m == 2, '{"frame_path": "top"}').when(m == 3, '{"selector_alternatives": {"css": [1], "text": null}}')
              .when(m == 4, '{"viewport_box": {"x": 1, "y": 2, "w": 3}}').when(m == 11, '{"shadow_path": ["a", null]}')
              .otherwise(F.concat(lit('{"url": '), json_quote("url"), lit(', "viewport_box": null}'))))
    viewport = F.when(m == 5, '{"w": 1, "h": 2, "dpr": "wide"}').otherwise('{"w": 1, "h": "2", "dpr": 1.5}')
    metadata = F.when(m == 6, '{"os": 5}').when(m == 7, '{"viewport": {"w": 10}}').otherwise('{"os": null}')
    notes = (F.when(m == 8, F.concat(lit('[{"ts_ms": 1, "text": '), html, lit('}, {"text": "t"}]'))).when(m == 9, lit('[{"ts_ms": 1.5, "text": "t"}]'))
             .otherwise(F.concat(lit('[{"ts_ms": "7", "text": '), html, lit("}]"))))
    redacted = F.when(m == 10, '"maybe"').otherwise("false")
    body = F.concat(lit('{"surface": "browser", "started_at": "2024-04-26T10:00:00Z", "ended_at": "2024-04-26T10:05:00Z", "metadata": '), metadata,
                    lit(', "notes": '), notes, lit(', "events": [{"id": "a", "ts_ms": 3, "type": "click", "target": '), target,
                    lit(', "viewport": '), viewport, lit(', "redacted": '), redacted, lit("}]}"))
    return p.select("page_id", lit("/recordings").alias("path"), lit("chrome-extension://abc").alias("origin"), body.alias("body"),
                    F.octet_length(body).cast("long").alias("content_length"))
