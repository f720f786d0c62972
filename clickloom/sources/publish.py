"""Publishing documents (A9), the screenshots that travel with them (A10)
and the redaction report written beside each document (A11).

A publication is one set: documents with their reports, recordings and screenshots, written under ``_sets/<id>`` and made
visible by one small file, ``_log/<number>``, that names the set.  Files of the log are created, never replaced, so of two
writers that plan on the same state one wins, and the other plans again on what the first has published.  Whoever reads
goes by the log: a set without its file, of a writer that died, doesn't exist.  ``root/scope=<scope>/name=<name>`` shows
the latest documents to readers that know nothing of the log; it is brought up to date after each commit."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from clickloom.session import delete_path

#: How often a writer plans anew because others were faster.
TRIES = 20


def publish_plan(requests: DataFrame, published: DataFrame, overwrite: bool = False, order: str = "doc") -> DataFrame:
    """Per publish request ``(scope, name)``: ``created``, ``replaced`` or
    ``conflict``.  Requests take effect in the order of ``order``: the first for
    a free target creates it, later ones find it taken; with ``overwrite``
    every one replaces what is there and the last stays."""
    w = W.partitionBy("scope", "name").orderBy(order)
    p = published.select("scope", "name").distinct().withColumn("__exists", F.lit(True))
    j = requests.withColumn("__n", F.row_number().over(w)).join(p, ["scope", "name"], "left")
    taken = F.coalesce(F.col("__exists"), F.lit(False)) | (F.col("__n") > 1)
    action = F.when(~taken, "created").when(F.lit(overwrite), "replaced").otherwise("conflict")
    return j.select(*requests.columns, action.alias("action"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def log(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """The publications: (number, set), one small entry each.  A file whose text isn't whole is of a writer that died, or
    hasn't finished: its number is taken, its set isn't published."""
    fs, path = _fs(spark, f"{root}/_log")
    if not fs.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if not s.getPath().getName().startswith("."))
    out = []
    for name in names:
        fs, p = _fs(spark, f"{root}/_log/{name}")
        stream = fs.open(p)
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            out.append((int(name), json.loads(text)["set"]))
        except ValueError:
            out.append((int(name), ""))
    return out


def commit(spark: SparkSession, root: str, number: int, set_id: str) -> bool:
    """Publish a set as the log's ``number``; false if another writer has taken the number."""
    fs, path = _fs(spark, f"{root}/_log/{number:010d}")
    try:
        out = fs.create(path, False)
    except Exception as e:  # noqa: BLE001
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(json.dumps({"set": set_id}).encode()))
    out.close()
    return True


def _of_sets(spark: SparkSession, root: str, part: str) -> DataFrame | None:
    """A part's rows in all published sets, with ``__set`` and ``__number``."""
    sets = [(n, s) for n, s in log(spark, root) if s]
    paths = [f"{root}/_sets/{s}/{part}" for _, s in sets]
    paths = [p for p in paths if (lambda f: f[0].exists(f[1]))(_fs(spark, p))]
    if not paths:
        return None
    rows = spark.read.parquet(*paths).withColumn("__set", F.regexp_extract(F.col("_metadata.file_path"), r"/_sets/([0-9a-f]+)/", 1))
    return rows.join(spark.createDataFrame(sets, "__number long, __set string"), "__set")


def published(spark: SparkSession, root: str) -> DataFrame:
    """What is published: ``scope, name, __number`` of the latest publication."""
    rows = _of_sets(spark, root, "entries")
    if rows is None:
        return spark.createDataFrame([], "scope string, name string, __number long")
    return rows.groupBy("scope", "name").agg(F.max("__number").alias("__number"))


def read_published(spark: SparkSession, root: str, part: str = "docs") -> DataFrame | None:
    """A part (``docs`` or one given to ``publish``) of everything that is published now; None: there is none."""
    rows = _of_sets(spark, root, part)
    return None if rows is None else rows.join(published(spark, root), ["scope", "name", "__number"]).drop("__number", "__set")


def publish(docs: DataFrame, root: str, overwrite: bool = False, order: str = "doc", parts: dict[str, DataFrame] | None = None, key: str = "doc") -> DataFrame:
    """Publish documents as one set and return the plan.  Without ``overwrite`` only documents with a free target are
    published, the others are conflicts; with it the targets named by ``docs`` are replaced, each by its last document,
    and no other target is touched.  ``parts`` are what travels with them (reports, recordings, screenshots), keyed by
    ``key``: the rows of published documents are in the set."""
    spark = docs.sparkSession
    for _ in range(TRIES):
        number = max((n for n, _ in log(spark, root)), default=0) + 1
        set_id = uuid.uuid4().hex
        base = f"{root}/_sets/{set_id}"
        planned = publish_plan(docs, published(spark, root), overwrite, order)
        planned.write.parquet(f"{base}/plan")
        plan = spark.read.schema(planned.schema).parquet(f"{base}/plan")
        if overwrite:
            last = W.partitionBy("scope", "name").orderBy(F.col(order).desc())
            win = plan.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", "action")
        else:
            win = plan.filter("action = 'created'").drop("action")
        win.write.parquet(f"{base}/docs")
        win = spark.read.schema(win.schema).parquet(f"{base}/docs")
        if win.isEmpty():
            return plan
        for name, rows in (parts or {}).items():
            rows.join(win.select(key, "scope", "name"), key).write.parquet(f"{base}/{name}")
        win.select("scope", "name").write.parquet(f"{base}/entries")
        if commit(spark, root, number, set_id):
            refresh(spark, root)
            return plan
        delete_path(spark, base)
    raise RuntimeError(f"{TRIES} other writers were faster")


def refresh(spark: SparkSession, root: str) -> None:
    """Bring ``root/scope=.../name=...`` up to date with the log: the documents of publications not shown yet, each
    target's latest.  Also mends what a writer that died after its commit left behind."""
    fs, mark = _fs(spark, f"{root}/_shown")
    shown = max((int(s.getPath().getName()) for s in fs.listStatus(mark)), default=0) if fs.exists(mark) else 0
    last = max((n for n, s in log(spark, root) if s), default=0)
    rows = _of_sets(spark, root, "docs")
    if rows is None or last == shown:
        return
    new = rows.join(published(spark, root), ["scope", "name", "__number"]).filter(F.col("__number") > shown).drop("__number", "__set")
    # few bytes, but a folder each: dealt out by targets to a fixed number of tasks, which Spark doesn't join by size
    tasks = 4 * spark.sparkContext.defaultParallelism
    new.repartition(tasks, "scope", "name").write.partitionBy("scope", "name").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(root)
    fs.mkdirs(_fs(spark, f"{root}/_shown/{last}")[1])


def copy_screenshots(blobs: DataFrame, published_recordings: DataFrame, keys="rec_id") -> DataFrame:
    """A10: the screenshots of recordings that were published."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    return blobs.join(published_recordings.select(*keys_l).distinct(), keys_l, "left_semi")


def write_report(lines: DataFrame, path: str, keys="rec_id") -> None:
    """REDACTIONS report lines written beside each document, one
    directory per recording, lines range-sorted so the files read in order."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    order = [*keys_l, "section", "k1", "k2", "k3", "k4"]
    (lines.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").partitionBy(*keys_l).parquet(path))
