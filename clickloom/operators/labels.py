"""Segment labels and drafts: parsing, schema checks, joins, payloads."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clickloom import model
from clickloom.functions import shapes
from clickloom.functions.scalars import json_quote
from clickloom.session import scratch_path


def _keys_of(text: Column) -> Column:
    return F.json_object_keys(text)


def _quoted(c: Column) -> Column:
    return F.coalesce(json_quote(c), F.lit("null"))


def event_json() -> Column:
    """An event as the label request and the payload carry it: all keys, nulls too, ``value`` as the JSON it is."""
    t = F.col("target")
    fields = [("id", _quoted(F.col("id"))), ("type", _quoted(F.col("type"))), ("value", F.coalesce("value_json", F.lit("null"))),
              ("target_url", _quoted(t["url"])), ("target_text", _quoted(t["selector_alternatives"]["text"])),
              ("target_role", _quoted(t["selector_alternatives"]["role_name"])),
              ("accessible_name", _quoted(t["accessible_name"])), ("screenshot_path", _quoted(F.col("screenshot_path")))]
    parts = [F.concat(F.lit(("{" if i == 0 else ", ") + f'"{k}": '), v) for i, (k, v) in enumerate(fields)]
    return F.concat(*parts, F.lit("}"))


def segment_events(segmented: DataFrame, keys="rec_id") -> DataFrame:
    """Per segment its events as one JSON array text in order (the segment is the unit the model reads)."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    ev = F.struct(F.col("ord"), event_json().alias("j"))
    g = segmented.groupBy(*keys_l, "seg").agg(F.array_sort(F.collect_list(ev)).alias("e"))
    return g.select(*keys_l, "seg", F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x["j"]), ", "), F.lit("]")).alias("events_json"))


def label_requests(segmented: DataFrame, summaries: DataFrame, keys="rec_id") -> DataFrame:
    """one JSON request per segment: index, duration_ms, events."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    g = segment_events(segmented, keys).join(summaries.select(*keys_l, "seg", "duration_ms", "event_count"), [*keys_l, "seg"])
    body = F.concat(F.lit('{"index": '), F.col("seg").cast("string"), F.lit(', "duration_ms": '), F.col("duration_ms").cast("string"),
                    F.lit(', "events": '), F.col("events_json"), F.lit("}"))
    return g.select(*keys_l, "seg", "event_count", body.alias("request_json"))


def parse_labels(responses: DataFrame, text: str = "response") -> DataFrame:
    """a response becomes a label when it is present, valid JSON with an
    ``intent``; confidence defaults to "low".  Others are dropped."""
    r = F.col(text)
    v = F.try_parse_json(r)
    ok = r.isNotNull() & v.isNotNull() & F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    has_intent = F.array_contains(_keys_of(r), "intent")
    p = F.from_json(r, model.LABEL)
    lab = responses.filter(ok).filter(has_intent)
    return lab.select("*", p["intent"].alias("intent"), p["target_description"].alias("target_description"),
                      p["expected_outcome"].alias("expected_outcome"),
                      F.when(F.array_contains(_keys_of(r), "confidence"), p["confidence"])
                      .otherwise(F.lit("low")).alias("confidence"))


def check_object_schema(text: Column, required: list[str], enums: dict[str, list[str]] | None = None) -> Column:
    """F5/F12 helper: problems of a JSON object: missing required keys, extra
    keys, out-of-list enum values (array of messages, empty = valid)."""
    keys = _keys_of(text)
    req = F.array(*[F.lit(k) for k in required])
    missing = F.transform(F.array_except(req, F.coalesce(keys, F.array().cast("array<string>"))),
                          lambda k: F.concat(F.lit("missing "), k))
    extra = F.transform(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), req),
                        lambda k: F.concat(F.lit("extra "), k))
    probs = F.concat(missing, extra)
    for k, allowed in (enums or {}).items():
        val = F.get_json_object(text, f"$.{k}")
        bad = val.isNotNull() & ~val.isin(*allowed)
        probs = F.concat(probs, F.when(bad, F.array(F.lit(f"bad {k}"))).otherwise(F.array().cast("array<string>")))
    return F.when(F.try_parse_json(text).isNull(), F.array(F.lit("invalid JSON"))).otherwise(probs)


def check_label_schema(responses: DataFrame, text: str = "response") -> DataFrame:
    """4 required keys, no extras, confidence in high/medium/low."""
    probs = check_object_schema(F.col(text), model.LABEL_REQUIRED_KEYS, {"confidence": model.CONFIDENCE_LEVELS})
    return responses.select("*", (F.size(probs) == 0).alias("ok"), F.array_join(probs, "; ").alias("problems"))


def label_join(summaries: DataFrame, labels: DataFrame, arrival: str = "arrival", keys="rec_id") -> DataFrame:
    """each segment with its label or null; several labels for one segment:
    the last to arrive wins (partial max_by before the join)."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    lab = F.struct("intent", "target_description", "expected_outcome", "confidence")
    last = labels.groupBy(*keys_l, "seg").agg(F.max_by(lab, F.col(arrival)).alias("label"))
    return summaries.join(last, [*keys_l, "seg"], "left")


def recording_duration_ms(started_us: Column, ended_us: Column) -> Column:
    """F8: int((ended - started).total_seconds() * 1000) with the same float steps."""
    return (((ended_us - started_us).cast("double") / F.lit(1e6)) * F.lit(1000.0)).cast("long")


def build_payload(recordings: DataFrame, summaries: DataFrame, labels: DataFrame | None = None,
                  notes: DataFrame | None = None, segmented: DataFrame | None = None, keys="rec_id") -> DataFrame:
    """per recording: surface, metadata (without its nulls), hint, duration_ms, annotations, segment_count and
    the (capped) segment list as JSON.  ``segmented`` gives the segments' events; without it their lists are empty."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    seg = summaries if labels is None else label_join(summaries, labels, keys=keys_l)
    if "label" not in seg.columns:
        seg = seg.withColumn("label", F.lit(None).cast(
            "struct<intent:string,target_description:string,expected_outcome:string,confidence:string>"))
    if segmented is not None:
        seg = seg.join(segment_events(segmented, keys_l), [*keys_l, "seg"], "left")
    else:
        seg = seg.withColumn("events_json", F.lit("[]"))
    body = F.concat(F.lit('{"index": '), F.col("seg").cast("string"), F.lit(', "duration_ms": '), F.col("duration_ms").cast("string"),
                    F.lit(', "event_count": '), F.col("event_count").cast("string"), F.lit(', "events": '), F.coalesce("events_json", F.lit("[]")),
                    F.lit(', "label": '), F.coalesce(F.to_json("label", {"ignoreNullFields": "false"}), F.lit("null")), F.lit("}"))
    per = seg.groupBy(*keys_l).agg(F.count(F.lit(1)).alias("segment_count"),
                                   F.array_sort(F.collect_list(F.struct("seg", body.alias("j")))).alias("segments"))
    out = recordings.join(per, keys_l, "left")
    empty = F.array().cast("array<struct<ts_ms:bigint,text:string>>")
    if notes is not None:
        n = notes.groupBy(*keys_l).agg(F.count(F.lit(1)).alias("n_notes"),
                                       F.array_sort(F.collect_list(F.struct("ts_ms", "text"))).alias("annotations"))
        out = out.join(n, keys_l, "left")
    else:
        out = out.withColumn("n_notes", F.lit(0).cast("long")).withColumn("annotations", empty)
    segments = F.array_join(F.transform(F.coalesce("segments", F.array().cast("array<struct<seg:bigint,j:string>>")), lambda x: x["j"]), ", ")
    payload = F.concat(
        F.lit('{"surface": '), _quoted(F.col("surface")), F.lit(', "metadata": '), F.coalesce(F.to_json("metadata"), F.lit("{}")),
        F.lit(', "user_intent_hint": '), _quoted(F.col("metadata.user_intent_hint")),
        F.lit(', "duration_ms": '), F.col("duration_ms").cast("string"),
        F.lit(', "annotations": '), F.to_json(F.coalesce("annotations", empty), {"ignoreNullFields": "false"}),
        F.lit(', "segment_count": '), F.coalesce("segment_count", F.lit(0)).cast("string"),
        F.lit(', "segments": ['), segments, F.lit("]}"))
    return out.select("*", payload.alias("payload_json"))


def pick_screenshots(summaries: DataFrame, manifest: DataFrame, cap: int = model.MAX_SCREENSHOTS,
                     keys="rec_id") -> DataFrame:
    """in segment order, the boundary screenshots that exist, each path
    once, at most ``cap`` per recording.  The per-(recording, path) minimum is
    a partial aggregate and ``row_number() <= cap`` is planned as a window
    group limit, so no recording is gathered whole."""
    from pyspark.sql import Window as W
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    s = summaries.filter(F.col("boundary_screenshot").isNotNull() & (F.col("boundary_screenshot") != ""))
    s = s.join(manifest.select(*keys_l, F.col("path").alias("boundary_screenshot")).distinct(),
               [*keys_l, "boundary_screenshot"], "left_semi")
    first = s.groupBy(*keys_l, F.col("boundary_screenshot").alias("path")).agg(F.min("seg").alias("seg"))
    w = W.partitionBy(*keys_l).orderBy("seg")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)


def image_block(paths: DataFrame, blobs: DataFrame, on: list[str]) -> DataFrame:
    """existing file -> base64 PNG block (Spark's base64 wraps lines; the
    block uses the unwrapped text)."""
    j = paths.join(blobs, on, "inner")
    data = F.regexp_replace(F.base64("bytes"), "[\r\n]", "")
    return j.select("*", F.struct(F.lit("image").alias("type"), F.struct(
        F.lit("base64").alias("type"), F.lit("image/png").alias("media_type"), data.alias("data")).alias("source")
    ).alias("block"))


def parse_drafts(results: DataFrame, text: str = "result", surface: str = "surface") -> DataFrame:
    """result JSON + recording surface -> ``draft`` (with the surface), or ``error``: no text, text that is no
    JSON object, a required key that is missing, or what the model of drafts and their steps has against it
    (``steps.2.goal: missing; ...``)."""
    t = F.col(text)
    kind = F.schema_of_variant(F.try_parse_json(t))
    found = shapes.problems(F.try_parse_json(t), model.DRAFT_SHAPE)
    needed = F.array(*[F.lit(k) for k in model.DRAFT_REQUIRED_KEYS])
    missing = F.array_except(needed, F.coalesce(_keys_of(t), F.array().cast("array<string>")))
    error = (F.when(t.isNull(), F.lit("Synthesis returned no text content"))
             .when(F.coalesce(~kind.startswith("OBJECT"), F.lit(True)), F.lit("Synthesis result is not a JSON object"))
             .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
             .otherwise(F.nullif(shapes.told(found), F.lit(""))))
    d = F.from_json(t, model.DRAFT).withField("surface", F.col(surface))
    checked = results.withColumn("error", error)
    return checked.select(*results.columns, F.when(F.col("error").isNull(), d).alias("draft"), "error")


def check_draft_schema(results: DataFrame, text: str = "result") -> DataFrame:
    """10 required top-level keys, 8 per step, no extras."""
    t = F.col(text)
    top = check_object_schema(t, model.DRAFT_REQUIRED_KEYS)
    steps = F.from_json(F.get_json_object(t, "$.steps"), "array<string>")
    step_probs = F.flatten(F.transform(F.coalesce(steps, F.array().cast("array<string>")),
                                       lambda s, i: F.transform(check_object_schema(s, model.STEP_REQUIRED_KEYS),
                                                                lambda p: F.concat(F.lit("step "), i.cast("string"), F.lit(": "), p))))
    probs = F.concat(top, step_probs)
    return results.select("*", (F.size(probs) == 0).alias("ok"), F.array_join(probs, "; ").alias("problems"))


# ------------------------------------------------------------ U1 labeler
LabelFn = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
LABEL_OUT = "rec_id bigint, seg bigint, intent string, target_description string, expected_outcome string, confidence string"


VERBS = {"click": "Click", "input": "Type into", "key": "Press", "scroll": "Scroll", "navigate": "Open", "file_upload": "Upload a file to"}


def rule_labels(requests: DataFrame) -> DataFrame:
    """Default deterministic labeler, in columns: the verb of the segment's first event and its best target
    description; no network."""
    first = F.from_json(F.get_json_object("request_json", "$.events[0]"),
                        "struct<type: string, target_text: string, accessible_name: string, target_url: string>")
    t = F.coalesce(first["type"], F.lit("event"))
    verb = F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 20)))
    for k, v in VERBS.items():
        verb = F.when(t == k, F.lit(v)).otherwise(verb)
    target = F.coalesce(*[F.nullif(first[k], F.lit("")) for k in ("target_text", "accessible_name", "target_url")])
    return requests.select("rec_id", "seg", F.concat_ws(" ", verb, F.coalesce(target, F.lit("the page"))).alias("intent"),
                           target.alias("target_description"), F.lit(None).cast("string").alias("expected_outcome"),
                           F.when(target.isNull(), "low").otherwise("medium").alias("confidence"))


def label_segments(requests: DataFrame, fn: LabelFn | None = None, schema: str = LABEL_OUT) -> DataFrame:
    """Run a pluggable labeler over label requests, partition-parallel
    (Arrow batches through ``mapInPandas``); the default is ``rule_labels``."""
    if fn is None:
        return rule_labels(requests)
    return requests.select("rec_id", "seg", "request_json").mapInPandas(fn, schema)


class Labeler(Protocol):
    """What a plug-in is.  It travels to the workers pickled, as it was before ``setup``."""

    #: Labelers of one name share their set-up in a worker.
    name: str

    def setup(self) -> Callable[[str], str]:
        """Open what answering needs (clients, models), once a worker; gives the function from request to response, both JSON
        texts.  It may raise: the request is then tried again, and in the end quarantined with the error."""


_READY: dict[str, Callable[[str], str]] = {}


def _ready(labeler: Labeler) -> Callable[[str], str]:
    """The labeler's function in this worker, which its later tasks find too."""
    if labeler.name not in _READY:
        _READY[labeler.name] = labeler.setup()
    return _READY[labeler.name]


def responses_of(requests: DataFrame, labeler: Labeler, tries: int = 1, keys=("rec_id", "seg")) -> DataFrame:
    """``keys, response, error`` of every request (``request_json``), each answered once: the answers are written, as they
    are read more than once and may be dear."""
    spark = requests.sparkSession
    keys_l = list(keys)

    def run(batches):
        answer = _ready(labeler)
        for batch in batches:
            said, errors = [], []
            for request in batch.column("request_json").to_pylist():
                response = error = None
                for _ in range(tries):
                    try:
                        response, error = answer(request), None
                        break
                    except Exception as e:  # noqa: BLE001  whatever a plug-in raises is an answer that failed
                        error = f"{type(e).__name__}: {e}"
                said.append(response)
                errors.append(error)
            yield pa.record_batch([*(batch.column(k) for k in keys_l), pa.array(said, pa.string()), pa.array(errors, pa.string())], names=[*keys_l, "response", "error"])

    schema = ", ".join(f"`{k}` {requests.schema[k].dataType.simpleString()}" for k in keys_l) + ", response string, error string"
    path = scratch_path(spark, "responses")
    requests.select(*keys_l, "request_json").mapInArrow(run, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def label_with(requests: DataFrame, labeler: Labeler, tries: int = 1, keys=("rec_id", "seg")) -> tuple[DataFrame, DataFrame]:
    """The labels of a plug-in (``keys`` and F5's columns), and the quarantine: ``keys, response, error`` of requests that
    failed, got no answer, or one that isn't a label (F5)."""
    keys_l = list(keys)
    checked = check_label_schema(responses_of(requests, labeler, tries, keys))
    error = F.coalesce(F.col("error"), F.when(F.col("response").isNull(), "no answer"), F.when(~F.col("ok"), F.concat(F.lit("not a label: "), F.col("problems"))))
    checked = checked.withColumn("error", error)
    p = F.from_json("response", model.LABEL)
    labels = checked.filter(F.col("error").isNull()).select(*keys_l, *[p[c].alias(c) for c in model.LABEL.names])
    return labels, checked.filter(F.col("error").isNotNull()).select(*keys_l, "response", "error")
