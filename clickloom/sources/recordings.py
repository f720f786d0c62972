"""Recording files: read single-document recordings (A1), write the
partitioned table layout (A8; ``documents.write_documents`` writes the
interchange documents), assemble envelopes (A12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clickloom import model
from clickloom.operators.normalize import apply_defaults
from clickloom.plans.ordered import CHUNK, DEFAULT_CHUNK_ROWS, chunk_if_hot
from clickloom.session import listing_by_cores

EVENT_FIELDS = ("struct<id:string, ts_ms:double, surface:string, type:string, screenshot_path:string, "
                "viewport:struct<w:bigint,h:bigint,dpr:double,zoom:double>, redacted:boolean, notes:string>")
REC_ID = r"([^/]+)/recording\.json$"


def load_documents(spark: SparkSession, glob: str, rec_id_pattern: str = REC_ID) -> DataFrame:
    """A1: ``recording.json`` documents, one row each, unknown fields ignored: rec_id, version, surface, started_at,
    ended_at, metadata, notes, events (raw JSON texts, so ``value`` keeps its exact form)."""
    shape = T.StructType([f if f.name != "events" else T.StructField("events", T.ArrayType(T.StringType())) for f in model.RECORDING.fields])
    with listing_by_cores(spark):
        doc = spark.read.schema(shape).option("multiLine", True).json(glob)
    viewport = F.col("metadata.viewport")
    return doc.select(
        F.regexp_extract(F.col("_metadata.file_path"), rec_id_pattern, 1).alias("rec_id"),
        F.coalesce("version", F.lit(model.SCHEMA_VERSION)).alias("version"), "surface", "started_at", "ended_at",
        F.when(F.col("metadata").isNotNull(), F.col("metadata").withField("viewport", F.when(viewport.isNotNull(), viewport.withField(
            "dpr", F.coalesce(viewport["dpr"], F.lit(1.0))).withField("zoom", F.coalesce(viewport["zoom"], F.lit(1.0)))))).alias("metadata"),
        F.coalesce("notes", F.array().cast(model.RECORDING["notes"].dataType)).alias("notes"),
        F.coalesce("events", F.array().cast("array<string>")).alias("events"))


def recording_events(docs: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """One row per event of ``load_documents`` in array order, with defaults (B6).  A recording without events has
    none; a null entry stays as a row of nulls, which validation (B5) rejects."""
    ev = docs.select("rec_id", F.posexplode("events").alias("pos", "ev"))
    e = F.from_json(F.col("ev"), EVENT_FIELDS)
    v = F.variant_get(F.try_parse_json(F.col("ev")), "$.value", "variant")
    shape = F.schema_of_variant(v)
    value_json = (F.when(v.isNull(), F.lit(None).cast("string"))
                  .when(shape.startswith("OBJECT") | shape.startswith("ARRAY"), F.get_json_object("ev", "$.value"))
                  .when(shape.isin("NULL", "VOID"), F.lit(None).cast("string"))
                  .otherwise(F.to_json(v)))
    target = F.from_json(F.coalesce(F.get_json_object("ev", "$.target"), F.lit("{}")), model.TARGET)
    out = ev.select(
        "rec_id", (F.col("pos") + 1).cast("long").alias("ord"), e["id"].alias("id"),
        e["ts_ms"].cast("long").alias("ts_ms"), e["surface"].alias("surface"), e["type"].alias("type"),
        value_json.alias("value_json"), target.alias("target"), e["screenshot_path"].alias("screenshot_path"),
        e["viewport"].alias("viewport"), e["redacted"].alias("redacted"), e["notes"].alias("notes"))
    return chunk_if_hot(apply_defaults(out), "rec_id", "ord", chunk_rows)


def recording_envelopes(docs: DataFrame, key: str = "rec_id") -> DataFrame:
    """The recordings themselves, those without events too: everything but the events, and their number."""
    return docs.select(key, "version", "surface", "started_at", "ended_at", "metadata", "notes",
                       F.size("events").cast("long").alias("n_events"))


def read_recordings(spark: SparkSession, glob: str, rec_id_pattern: str = REC_ID, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """A1 (+B6): the events of all documents; ``load_documents`` and ``recording_envelopes`` give the rest of them."""
    return recording_events(load_documents(spark, glob, rec_id_pattern), chunk_rows)


def write_recordings(events: DataFrame, envelopes: DataFrame, path: str, keys="rec_id") -> None:
    """The partitioned table layout: ``<path>/recordings`` (one JSON row per
    recording, null fields omitted) and ``<path>/events`` (one JSON row per
    event keyed (rec_id, ord)), events range-partitioned by (rec_id, ord)."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    envelopes.write.mode("overwrite").option("ignoreNullFields", "true").json(f"{path}/recordings")
    cols = [c for c in events.columns if c != CHUNK]
    (events.select(*cols).repartitionByRange(*keys_l, "ord").sortWithinPartitions(*keys_l, "ord")
     .write.mode("overwrite").option("ignoreNullFields", "true").json(f"{path}/events"))


def assemble_recordings(events: DataFrame, sessions: DataFrame | None = None, notes: DataFrame | None = None, keys="rec_id") -> DataFrame:
    """The envelope of every recording: version, surface, started_at, ended_at, metadata, notes, and from its
    events their number, the first and last (by order), the earliest and latest time.

    ``sessions`` tells what the recorder knew (any of version, surface, started_at, ended_at, metadata), one row a
    recording, and names recordings without events too; where it tells nothing, surface is that of the first event
    and the times are those of the events.  ``notes`` (ts_ms, text, and ord if their order isn't that of time) become
    a list.  Event aggregates are partial; the events themselves stay rows, which ``write_documents`` streams."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    out = events.groupBy(*keys_l).agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ts_ms").alias("started_ms"), F.max("ts_ms").alias("ended_ms"),
        F.min_by("id", "ord").alias("first_id"), F.max_by("id", "ord").alias("last_id"), F.min_by("surface", "ord").alias("__surface"))
    have = [] if sessions is None else [c for c in ("version", "surface", "started_at", "ended_at", "metadata") if c in sessions.columns]
    if sessions is not None:
        out = sessions.select(*keys_l, *have).join(out, keys_l, "full")
    if notes is not None:
        order = ["ord"] if "ord" in notes.columns else []
        n = notes.groupBy(*keys_l).agg(F.array_sort(F.collect_list(F.struct(*order, F.col("ts_ms").cast("long").alias("ts_ms"), "text"))).alias("__notes"))
        out = out.join(n, keys_l, "left").withColumn("__notes", F.transform("__notes", lambda x: F.struct(x["ts_ms"].alias("ts_ms"), x["text"].alias("text"))))
    told = lambda c, other: F.coalesce(F.col(c), other) if c in have else other
    iso = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    none = F.array().cast(model.RECORDING["notes"].dataType)
    return out.select(
        *keys_l, told("version", F.lit(model.SCHEMA_VERSION)).alias("version"), told("surface", F.col("__surface")).alias("surface"),
        told("started_at", iso("started_ms")).alias("started_at"), told("ended_at", iso("ended_ms")).alias("ended_at"),
        (F.col("metadata") if "metadata" in have else F.lit(None).cast(model.METADATA)).alias("metadata"),
        (F.coalesce("__notes", none) if notes is not None else none).alias("notes"),
        F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"), "started_ms", "ended_ms", "first_id", "last_id")
