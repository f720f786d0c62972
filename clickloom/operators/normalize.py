"""Projections, filters and normalisation of raw recorder output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clickloom import model
from clickloom.functions import shapes
from clickloom.functions.scalars import accessible_name, col_, js_round, json_has_key, trunc_to_long


def ensure_surface(raw_event_json: Column | str, surface: str = "browser") -> Column:
    """B1: the event's surface, or ``surface`` when the key is absent.  An
    explicit JSON null stays null (and fails validation later)."""
    ev = col_(raw_event_json)
    return F.when(json_has_key(ev, "surface"), F.get_json_object(ev, "$.surface")).otherwise(F.lit(surface))


def normalize_ts(ts: Column | str) -> Column:
    """B2: float ms -> int, truncating towards zero; ints unchanged."""
    return trunc_to_long(ts)


def renumber_events(ord_col: Column | str = "ord") -> Column:
    """``evt_%04d`` from the 1-based array position (no truncation >= 5 digits)."""
    return F.format_string("evt_%04d", col_(ord_col))


def live_event_ids(events: DataFrame, keep: Column, keys="rec_id", order: str = "ord",
                   out: str = "live_n") -> DataFrame:
    """Arrival counter over the events a live recorder keeps (clicks,
    scrolls, key presses); desktop ``evt_%04d``, browser ``evt_N``."""
    from clickloom.plans.ordered import dense_ordinal
    kept = events.filter(keep)
    kept = dense_ordinal(kept, keys, order, out)
    return kept.select("*", F.format_string("evt_%04d", F.col(out)).alias("desktop_id"),
                       F.concat(F.lit("evt_"), F.col(out).cast("string")).alias("browser_id"))


def event_rule_violations(events: DataFrame) -> Column:
    """B5 (event part): list of failed rules for one event."""
    t, s = F.col("type"), F.col("surface")
    checks = [
        (F.col("id").isNull(), "id missing"),
        (F.col("ts_ms").isNull(), "ts_ms missing"),
        (s.isNull() | ~s.isin(*model.SURFACES), "surface invalid"),
        (t.isNull() | ~t.isin(*model.EVENT_TYPES), "type invalid"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(msg)) for c, msg in checks]), lambda x: x.isNotNull())


def validate_recordings(events: DataFrame, recordings: DataFrame | None = None, keys="rec_id") -> DataFrame:
    """A recording is valid only if every event passes; one bad event
    rejects the whole recording.  Returns keys, valid, n_bad (partial aggs)."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    ev = events.select(*keys_l, (F.size(event_rule_violations(events)) > 0).alias("bad"))
    per = ev.groupBy(*keys_l).agg(F.sum(F.col("bad").cast("long")).alias("n_bad"))
    if recordings is not None:
        r = recordings
        rec_ok = (r["surface"].isin(*model.SURFACES) & r["started_at"].isNotNull() & r["ended_at"].isNotNull())
        per = r.select(*keys_l, rec_ok.alias("rec_ok")).join(per, keys_l, "left")
        per = per.select(*keys_l, F.coalesce("n_bad", F.lit(0)).alias("n_bad"), "rec_ok")
    else:
        per = per.withColumn("rec_ok", F.lit(True))
    return per.select(*keys_l, ((F.col("n_bad") == 0) & F.col("rec_ok")).alias("valid"),
                      F.col("n_bad").cast("long").alias("n_bad"))


def validate_documents(docs: DataFrame, text: str = "body", shape=model.RECORDING_SHAPE) -> DataFrame:
    """B5 on the JSON itself, before any field is lost to a type: ``valid`` and ``problems`` (path, reason) of each
    document; text that is no JSON object has one problem, without a path."""
    v = F.try_parse_json(F.col(text))
    is_object = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    not_one = F.array(F.struct(F.lit("").alias("path"), F.lit("not a JSON object").alias("reason")))
    out = docs.withColumn("problems", F.when(is_object, shapes.problems(v, shape)).otherwise(not_one))
    return out.withColumn("valid", F.size("problems") == 0)


def schema_problems(docs: DataFrame, keys="rec_id", text: str = "body", shape=model.RECORDING_SHAPE) -> DataFrame:
    """One row for each problem of each document: ``keys, path, reason``."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    return validate_documents(docs, text, shape).select(*keys_l, F.inline("problems"))


def apply_defaults(events: DataFrame) -> DataFrame:
    """Redacted false, viewport dpr/zoom 1.0, empty frame/shadow paths."""
    out = events
    if "redacted" in out.columns:
        out = out.withColumn("redacted", F.coalesce("redacted", F.lit(False)))
    if "viewport" in out.columns:
        vp = F.col("viewport")
        out = out.withColumn("viewport", F.when(vp.isNotNull(), F.struct(
            vp["w"].alias("w"), vp["h"].alias("h"),
            F.coalesce(vp["dpr"], F.lit(1.0)).alias("dpr"), F.coalesce(vp["zoom"], F.lit(1.0)).alias("zoom"))))
    if "target" in out.columns:
        tg = F.col("target")
        out = out.withColumn("target", tg.withField("frame_path", F.coalesce(tg["frame_path"], F.array().cast("array<string>")))
                             .withField("shadow_path", F.coalesce(tg["shadow_path"], F.array().cast("array<string>"))))
    return out


def is_secret_field(input_type: Column, autocomplete: Column, aria_label: Column, is_input: Column) -> Column:
    """B7 element test: password input, password/one-time-code/cc-* autocomplete,
    or an aria-label naming a secret."""
    ac = F.lower(F.coalesce(autocomplete, F.lit("")))
    label = F.lower(F.coalesce(aria_label, F.lit("")))
    input_rule = is_input & ((input_type == "password") | ac.contains("password")
                             | (ac == "one-time-code") | ac.startswith("cc-"))
    return F.coalesce(input_rule, F.lit(False)) | label.rlike(model.SECRET_LABEL_PATTERN)


def drop_secret_fields(events: DataFrame, secret: Column) -> DataFrame:
    """input/change/key events on secret fields never leave the page."""
    return events.filter(~(F.col("type").isin("input", "change", "key", "file_upload") & secret))


def admit_keys(key: Column, ctrl: Column, meta: Column, alt: Column) -> Column:
    """Named keys, or a modifier chord with a one-character key."""
    chord = F.coalesce(ctrl, F.lit(False)) | F.coalesce(meta, F.lit(False)) | F.coalesce(alt, F.lit(False))
    return key.isin(*model.BROWSER_NAMED_KEYS) | (chord & (F.char_length(key) == 1))


def key_projection(key: Column, ctrl: Column, shift: Column, alt: Column, meta: Column) -> Column:
    """The emitted key value: lower-cased key and the four modifier flags."""
    return F.struct(F.lower(key).alias("key"), ctrl.alias("ctrl"), shift.alias("shift"),
                    alt.alias("alt"), meta.alias("meta"))


def press_only_clicks(events: DataFrame, pressed: str = "pressed", button: str = "button") -> DataFrame:
    """Drop button releases; button name = last dotted part."""
    return (events.filter(F.col(pressed))
            .withColumn(button, F.substring_index(F.col(button), ".", -1)))


def nav_from_tab_updates(updates: DataFrame) -> DataFrame:
    """Completed tab updates with a non-empty url become navigate events
    with value {"tab_id": n}."""
    u = updates.filter((F.col("status") == "complete") & F.col("url").isNotNull() & (F.col("url") != ""))
    return u.select("*", F.lit("navigate").alias("type"),
                    F.to_json(F.struct(F.col("tab_id").alias("tab_id"))).alias("value_json"))


def file_upload_projection(files: Column | str) -> Column:
    """File list -> [{filename, mime, size}]."""
    return F.transform(col_(files), lambda f: F.struct(f["name"].alias("filename"), f["type"].alias("mime"),
                                                       f["size"].alias("size")))


def form_submit_events(submits: DataFrame) -> DataFrame:
    """Raw submit events become annotations whose value says so."""
    return submits.select("*", F.lit("annotation").alias("type"), F.lit('{"kind":"form_submit"}').alias("value_json"))


def selector_strings(testid: Column, aria: Column, role: Column, tag: Column, name: Column) -> Column:
    """Ranked selector alternatives of an element."""
    r = F.coalesce(F.nullif(role, F.lit("")), F.lower(tag))
    has_name = name.isNotNull() & (name != "")
    return F.struct(
        F.when(F.coalesce(testid, F.lit("")) != "", F.concat(F.lit('[data-testid="'), testid, F.lit('"]'))).alias("testid"),
        F.when(F.coalesce(aria, F.lit("")) != "", F.concat(F.lit('[aria-label="'), aria, F.lit('"]'))).alias("aria"),
        F.when(has_name, F.concat(r, F.lit("::"), name)).alias("role_name"),
        F.when(has_name, name).alias("text"),
    )


def viewport_box(left: Column, top: Column, width: Column, height: Column) -> Column:
    """JavaScript-rounded element rectangle."""
    return F.struct(js_round(left).alias("x"), js_round(top).alias("y"),
                    js_round(width).alias("w"), js_round(height).alias("h"))


def allowed_origin(df: DataFrame, origin: str = "origin") -> DataFrame:
    """Rows whose origin starts with an allow-listed prefix.  The prefix
    list is a fixed two-row table, so broadcasting it is size-safe."""
    spark = df.sparkSession
    prefixes = spark.createDataFrame([(p,) for p in model.ALLOWED_ORIGIN_PREFIXES], "prefix string")
    return df.join(F.broadcast(prefixes), F.col(origin).startswith(F.col("prefix")), "left_semi")


def data_url_payload(data_url: Column | str) -> Column:
    """Text between the first and second comma (JS split with limit 2)."""
    return F.try_element_at(F.split(col_(data_url), ","), F.lit(2))


def visual_filter(type_col: Column | str = "type") -> Column:
    """Events that trigger a screenshot."""
    return col_(type_col).isin(*model.VISUAL_EVENT_TYPES)


__all__ = [n for n in dir() if not n.startswith("_")] + ["accessible_name"]
