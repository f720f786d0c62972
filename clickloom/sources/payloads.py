"""Upload payloads: admission status with quarantine, screenshot blobs,
normalised events (A2, A5, A6 with B1-B3), archives (A3), directory names (A7).

A payload row carries ``path``, ``origin``, ``content_length`` and ``body``
(JSON text).  Every rule is a column expression, so admission runs as one
narrow projection over any number of uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clickloom import model
from clickloom.functions import shapes
from clickloom.session import listing_by_cores, scratch_path

B64_CHARS = "A-Za-z0-9+/"


def b64_ok(s: Column) -> Column:
    """Lenient base64 decoding succeeds (non-alphabet characters are skipped;
    the data length must fit the padding)."""
    d = F.char_length(F.regexp_replace(s, f"[^{B64_CHARS}]", ""))
    p = F.char_length(F.regexp_replace(s, "[^=]", ""))
    r = d % 4
    return (r == 0) | ((r == 2) & (p >= 2)) | ((r == 3) & (p >= 1))


def b64_decode(s: Column) -> Column:
    clean = F.regexp_replace(s, f"[^{B64_CHARS}]", "")
    return F.unbase64(F.concat(clean, F.substring(F.lit("=="), 1, (F.lit(4) - F.char_length(clean) % 4) % 4)))


def _events_raw(body: Column) -> Column:
    return F.from_json(body, "struct<events: array<string>>")["events"]


def _st(code: int, msg: str | None) -> Column:
    return F.struct(F.lit(code).alias("s"), F.lit(msg).cast("string").alias("e"))


def admission(payloads: DataFrame, most: int = model.MAX_BODY_BYTES) -> DataFrame:
    """A5: ``status``/``error`` per upload, first failing rule wins; ``problems`` lists what the recording model has against
    a body (path, reason), whose first is in ``error``."""
    body = F.col("body")
    v = F.try_parse_json(body)
    kind = F.schema_of_variant(v)
    is_obj = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    ev_kind = F.schema_of_variant(F.variant_get(v, "$.events", "variant"))
    events_is_list = F.coalesce(ev_kind.startswith("ARRAY"), F.lit(False))
    raw = _events_raw(body)
    all_objects = F.forall(F.coalesce(raw, F.array().cast("array<string>")),
                           lambda e: F.coalesce(F.ltrim(e).startswith("{"), F.lit(False)))
    shots = F.transform(F.coalesce(raw, F.array().cast("array<string>")),
                        lambda e: F.get_json_object(e, "$.screenshot_data"))
    shots_ok = F.forall(shots, lambda s: s.isNull() | (s == "") | b64_ok(s))
    surface_ok = F.coalesce(F.get_json_object(body, "$.surface") == "browser", F.lit(False))
    origin_ok = F.lit(False)
    for p in model.ALLOWED_ORIGIN_PREFIXES:
        origin_ok = origin_ok | F.coalesce(F.col("origin").startswith(p), F.lit(False))
    n = F.col("content_length")
    status = (F.when(F.col("path") != model.UPLOAD_PATH, _st(404, "not found"))
              .when(~origin_ok, _st(403, "origin not allowed"))
              .when(F.coalesce(n, F.lit(0)) <= 0, _st(400, "empty body"))
              .when(n > most, _st(413, "body too large"))
              .when(v.isNull(), _st(400, "invalid JSON"))
              .when(~is_obj, _st(500, "write failed"))
              .when(~events_is_list, _st(422, "payload missing 'events' array"))
              .when(~all_objects, _st(422, "event entries must be objects"))
              .when(~shots_ok, _st(422, "invalid base64 screenshot"))
              .when(~surface_ok, _st(422, "expected surface=browser"))
              .otherwise(_st(201, None)))
    checked = payloads.withColumn("__st", status)
    found = F.when(F.col("__st")["s"] == 201, shapes.problems(F.try_parse_json(body), model.UPLOAD_SHAPE)).otherwise(F.array().cast(shapes.PROBLEMS))
    checked = checked.withColumn("problems", found)
    bad = F.size("problems") > 0
    first = F.col("problems")[0]
    error = F.concat(F.lit("invalid recording: "), first["path"], F.lit(": "), first["reason"])
    return checked.select(*payloads.columns, F.when(bad, 422).otherwise(F.col("__st")["s"]).alias("status"),
                          F.when(bad, error).otherwise(F.col("__st")["e"]).alias("error"), "problems")


def quarantine(admitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into accepted (201) and quarantined uploads."""
    return admitted.filter(F.col("status") == 201), admitted.filter(F.col("status") != 201)


def payload_documents(accepted: DataFrame, key: str = "page_id") -> DataFrame:
    """A2: one parse of each accepted upload, keyed, with the columns of ``load_documents``: ``recording_envelopes`` and
    ``payload_events`` take it apart."""
    shape = "struct<" + ", ".join(f"{f.name}: {'array<string>' if f.name == 'events' else f.dataType.simpleString()}" for f in model.RECORDING.fields) + ">"
    d = accepted.select(key, F.from_json("body", shape).alias("d"))
    metadata, viewport = F.col("d.metadata"), F.col("d.metadata.viewport")
    sized = F.when(viewport.isNotNull(), viewport.withField("dpr", F.coalesce(viewport["dpr"], F.lit(1.0))).withField("zoom", F.coalesce(viewport["zoom"], F.lit(1.0))))
    return d.select(key, F.coalesce("d.version", F.lit(model.SCHEMA_VERSION)).alias("version"), "d.surface", "d.started_at", "d.ended_at",
                    F.when(metadata.isNotNull(), metadata.withField("viewport", sized)).alias("metadata"),
                    F.coalesce("d.notes", F.array().cast(model.RECORDING["notes"].dataType)).alias("notes"),
                    F.coalesce("d.events", F.array().cast("array<string>")).alias("events"))


def safe_name(name: Column) -> Column:
    """An id as part of a file name: path separators and dots at its start become underscores."""
    return F.regexp_replace(F.regexp_replace(name, r"[/\\\x00-\x1f]", "_"), r"^\.+", "_")


def payload_events(accepted: DataFrame, key: str = "page_id") -> DataFrame:
    """A2 + B1-B3 + A6 path: one row per event of each accepted upload, in
    array order, with all fields of the recording model (so it feeds the build
    flow as it is): surface defaulted when absent, float ts truncated, ids
    renumbered, defaults applied; a screenshot's path is named by the
    pre-renumber id.  ``accepted`` are uploads or their ``payload_documents``."""
    docs = accepted if "body" not in accepted.columns else payload_documents(accepted, key)
    x = docs.select(key, F.posexplode("events").alias("pos", "ev"))
    e = F.col("ev")
    orig_id = F.get_json_object(e, "$.id")
    shot = F.get_json_object(e, "$.screenshot_data")
    has_shot = shot.isNotNull() & (shot != "")
    from clickloom.operators.normalize import apply_defaults, ensure_surface, normalize_ts, renumber_events
    ord_ = (F.col("pos") + 1).cast("long")
    v = F.variant_get(F.try_parse_json(e), "$.value", "variant")
    shape = F.schema_of_variant(v)
    value = (F.when(v.isNull() | (shape == "VOID"), F.lit(None).cast("string"))
             .when(shape.startswith("OBJECT") | shape.startswith("ARRAY"), F.get_json_object(e, "$.value")).otherwise(F.to_json(v)))
    target = F.from_json(F.coalesce(F.get_json_object(e, "$.target"), F.lit("{}")), model.TARGET)
    rest = F.from_json(e, "struct<viewport: struct<w:bigint,h:bigint,dpr:double,zoom:double>, redacted: boolean, notes: string>")
    out = x.select(
        key, ord_.alias("ord"), renumber_events(ord_).alias("id"), orig_id.alias("orig_id"),
        normalize_ts(F.get_json_object(e, "$.ts_ms")).alias("ts_ms"),
        ensure_surface(e).alias("surface"), F.get_json_object(e, "$.type").alias("type"),
        value.alias("value_json"), target.alias("target"), target["url"].alias("url"),
        F.when(has_shot, F.concat(F.lit("screenshots/"), safe_name(F.coalesce(orig_id, F.lit("evt"))), F.lit(".png")))
        .otherwise(F.get_json_object(e, "$.screenshot_path")).alias("screenshot_path"),
        rest["viewport"].alias("viewport"), rest["redacted"].alias("redacted"), rest["notes"].alias("notes"),
        F.when(has_shot, b64_decode(shot)).alias("screenshot_bytes"),
    )
    return apply_defaults(out)


def screenshot_blobs(events: DataFrame, key: str = "page_id") -> DataFrame:
    """``(key, path, bytes)``; blobs live apart from events so event scans
    never read image bytes."""
    return events.filter(F.col("screenshot_bytes").isNotNull()).select(
        key, F.col("screenshot_path").alias("path"), F.col("screenshot_bytes").alias("bytes"))


def recording_dir_names(starts: DataFrame, ts: str = "started_at", order: str = "arrival",
                        out: str = "dir_name") -> DataFrame:
    """``browser-<YYYYMMDDTHHMMSS>``, ``-1``, ``-2``... for later arrivals in
    the same second.  The arrival ordinal per second uses the chunked dense
    ordinal, so one busy second is not numbered in a single task."""
    from clickloom.plans.ordered import dense_ordinal
    base = F.concat(F.lit("browser-"), F.date_format(F.col(ts), "yyyyMMdd'T'HHmmss"))
    s = starts.withColumn("__base", base)
    s = dense_ordinal(s, "__base", order, "__n")
    name = F.when(F.col("__n") == 1, F.col("__base")).otherwise(
        F.concat(F.col("__base"), F.lit("-"), (F.col("__n") - 1).cast("string")))
    return s.withColumn(out, name).drop("__base", "__n")


def free_dir_names(starts: DataFrame, taken: DataFrame, ts: str = "started_at", order: str = "arrival", out: str = "dir_name") -> DataFrame:
    """A7 for a later batch: each start gets the smallest number that is free in its second, in order of arrival.
    ``taken``: ``base`` and ``number`` (0: the name without suffix) of the folders there are, each once.

    The k-th free number is k plus the taken ones before it, and a taken number t with i taken ones before it stands
    before the free number t - i.  So both sides are numbered densely, laid in one order, and the taken ones counted up
    to each start: no range is spelled out and no second is handled in one task."""
    from clickloom.plans.ordered import chunk_if_hot, dense_ordinal, with_running
    base = F.concat(F.lit("browser-"), F.date_format(F.col(ts), "yyyyMMdd'T'HHmmss"))
    s = dense_ordinal(starts.withColumn("__base", base), "__base", order, "__k").withColumn("__k", F.col("__k") - 1)
    t = taken.select(F.col("base").alias("__base"), F.col("number").cast("long").alias("number")).join(s.select("__base"), "__base", "left_semi")
    t = dense_ordinal(t, "__base", "number", "__i").select("__base", (F.col("number") - F.col("__i") + 1).alias("at"), F.lit(1).alias("one"), F.col("number").alias("nth"))
    both = t.unionByName(s.select("__base", F.col("__k").alias("at"), F.lit(0).alias("one"), F.col("__k").alias("nth")))
    # taken ones first where both stand at one place
    both = both.withColumn("pos", F.col("at") * 2 + 1 - F.col("one"))
    both = with_running(chunk_if_hot(both, "__base", "pos"), {"before": (F.col("one").cast("long"), "sum")}, keys="__base", ord=["pos", "nth"])
    free = both.filter("one = 0").select("__base", F.col("nth").alias("__k"), (F.col("nth") + F.col("before")).alias("__number"))
    name = F.when(F.col("__number") == 0, F.col("__base")).otherwise(F.concat(F.col("__base"), F.lit("-"), F.col("__number").cast("string")))
    return s.join(free, ["__base", "__k"]).withColumn(out, name).withColumn("dir_base", F.col("__base")).withColumn("dir_number", F.col("__number")).drop("__base", "__k", "__number")


def assign_dirs(starts: DataFrame, registry: str, batch: int, **options) -> DataFrame:
    """A7 across batches: names free in the registry, and their entry there under ``batch``.  A batch that runs again
    sees the registry without its own entry, and replaces it."""
    spark = starts.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(registry)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    shape = "base string, number long, batch_id long"
    taken = spark.read.schema(shape).parquet(registry).filter(F.col("batch_id") != batch) if there else spark.createDataFrame([], shape)
    named = free_dir_names(starts, taken, **options)
    # the registry is what counts: the names are those written there
    named.select("*", F.col("dir_base").alias("base"), F.col("dir_number").alias("number")).write.mode("overwrite").parquet(f"{registry}/batch_id={batch}")
    return spark.read.parquet(f"{registry}/batch_id={batch}").select(*named.columns)


def _dealt(bodies: DataFrame, key: str) -> DataFrame:
    """Rows dealt out to at least as many tasks as there are cores, those of one key together and in a row."""
    spark = bodies.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return bodies.repartition(n, key).sortWithinPartitions(key)


def write_uploads(bodies: DataFrame, path: str) -> None:
    """Land uploads: ``<name>.txt`` holds the bodies of the rows of that ``name``, a line end behind each, all in one
    folder, which is listed at once.  Written by the executors through Arrow's file systems."""
    none = "__HIVE_DEFAULT_PARTITION__"

    def write(batches):
        from clickloom.sources.files import NewFile
        out = last = None
        for batch in batches:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist()):
                if out is None or name != last:
                    if out is not None:
                        out.publish()
                    out, last = NewFile(f"{path}/{none if name is None else name}.txt"), name
                out.write((body or "") + "\n")
        if out is not None:
            out.publish()
        yield from ()

    _dealt(bodies.select("name", "body"), "name").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def write_archives(bodies: DataFrame, path: str) -> None:
    """Export: one ``<name>.zip`` per row holding ``recording.json``, written by the executors
    through Arrow's file systems into a folder that all of them share."""
    import io
    import zipfile

    def write(batches):
        from clickloom.sources.files import NewFile
        for batch in batches:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist()):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as zf:
                    zf.writestr("recording.json", body or "")
                out = NewFile(f"{path}/{name}.zip")
                out.write(held.getvalue())
                out.publish()
        yield from ()

    _dealt(bodies.select("name", "body"), "name").mapInArrow(write, "file string").write.format("noop").mode("overwrite").save()


def archive_uploads(spark, glob: str) -> DataFrame:
    """A3: many exported archives at once, each with its ``status`` and ``error``: only ``recording.json`` at the
    archive root is read, then the payload rules apply (no HTTP checks); a file that is no archive, or has no such
    entry, is 422."""
    import io
    import zipfile

    def unzip(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                body = bad = None
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as zf:
                        body = zf.read("recording.json").decode("utf-8")
                except KeyError:
                    bad = "archive has no recording.json"
                except (zipfile.BadZipFile, UnicodeDecodeError):
                    bad = "not a readable archive"
                out.append((p, body, bad))
            yield pd.DataFrame(out, columns=["file", "body", "bad"])

    with listing_by_cores(spark):
        raw = spark.read.format("binaryFile").load(glob).select("path", "content")
    bodies = raw.coalesce(16 * spark.sparkContext.defaultParallelism).mapInPandas(unzip, "file string, body string, bad string")
    p = bodies.select("file", "body", "bad", F.lit(model.UPLOAD_PATH).alias("path"),
                      F.lit(model.ALLOWED_ORIGIN_PREFIXES[0]).alias("origin"),
                      F.octet_length("body").cast("long").alias("content_length"))
    a = admission(p)
    return (a.withColumn("status", F.when(F.col("bad").isNotNull(), 422).otherwise(F.col("status")))
            .withColumn("error", F.coalesce("bad", "error")).drop("bad"))


def _kept_uploads(spark, glob: str) -> DataFrame:
    """``archive_uploads`` written to scratch: the archives are opened and judged once, whatever is read of them."""
    path = scratch_path(spark, "archive-uploads")
    archive_uploads(spark, glob).select("file", "body", "status", "error").write.parquet(path)
    return spark.read.parquet(path)


def read_archives(spark, glob: str) -> tuple[DataFrame, DataFrame]:
    """A3: events of the accepted archives, and the rejected archives with their reasons."""
    accepted, rejected = quarantine(_kept_uploads(spark, glob))
    return payload_events(accepted, key="file"), rejected.select("file", "status", "error")


def read_archive_documents(spark, glob: str) -> tuple[DataFrame, DataFrame]:
    """A3: the accepted archives as ``payload_documents`` (keyed by ``file``: events and envelopes), and the rejected ones."""
    accepted, rejected = quarantine(_kept_uploads(spark, glob))
    return payload_documents(accepted, key="file"), rejected.select("file", "status", "error")
