"""Streams: batches that come twice, late rows, state that expires, files too long to open."""
import os
import random
import tempfile

from pyspark.sql import functions as F

from clickloom.operators.compact import throttle
from clickloom.streaming.live import intake, run_available, session_status, throttle_state, write_batch

SCHEMA = "rec_id bigint, ord bigint, ts_ms bigint, type string"


class Stream:
    """Micro-batches of rows, one run of the query each."""

    def __init__(self, spark, query):
        root = tempfile.mkdtemp(prefix="stream-")
        self.spark, self.query = spark, query
        self.landing, self.sink, self.checkpoint = (f"{root}/{x}" for x in ("in", "out", "ckpt"))
        self.n = 0

    def send(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{self.landing}/{self.n}")
        df = self.spark.readStream.schema(SCHEMA).parquet(f"{self.landing}/*")
        run_available(self.query(df), self.sink, self.checkpoint)

    def rows(self):
        return self.spark.read.parquet(self.sink).collect() if os.path.exists(self.sink) else []


def click(rec, ord_, ts, kind="click"):
    return (rec, ord_, ts, kind)


def test_a_batch_that_runs_twice_counts_once(spark):
    root = tempfile.mkdtemp(prefix="sink-")
    put = write_batch(root)
    put(spark.range(5), 0)
    put(spark.range(5, 9), 1)
    put(spark.range(5, 9), 1)
    assert sorted(r["id"] for r in spark.read.parquet(root).collect()) == list(range(9))


def test_status_stops_expires_and_drops_late_rows(spark):
    s = Stream(spark, lambda df: session_status(df, F.col("type") == "stop", idle_ms=60_000, watermark="1 second"))
    latest = lambda: {r["rec_id"]: (r["n_events"], r["recording"]) for r in sorted(s.rows(), key=lambda r: (r["batch_id"], not r["recording"]))}
    s.send([click(1, i, 1_000_000 + i) for i in range(4)] + [click(2, 0, 1_000_000), click(2, 2, 1_000_020), click(2, 1, 1_000_010, "stop")])
    assert latest() == {1: (4, True), 2: (1, False)}
    s.send([click(1, 4, 1_030_000), click(2, 3, 1_030_000)])  # after its stop nothing is recorded
    assert latest() == {1: (5, True), 2: (1, False)}
    s.send([click(3, 0, 1_200_000)])  # the others are silent for more than a minute
    assert latest() == {1: (5, False), 2: (1, False), 3: (1, True)}
    s.send([click(1, 5, 1_031_000)])  # too late to be taken up again
    assert latest()[1] == (5, False)
    s.send([click(1, 6, 1_260_000)])  # its state is gone: a new count
    assert latest()[1] == (1, True)


def test_throttle_state_equals_batch_over_micro_batches(spark):
    rnd = random.Random(5)
    rows, t = [], {}
    for i in range(400):
        rec = rnd.randint(1, 3)
        t[rec] = t.get(rec, 2_000_000) + rnd.choice([0, 20, 90, 200, 400, 3000])
        rows.append(click(rec, i, t[rec]))
    s = Stream(spark, lambda df: throttle_state(df, 250, watermark="1 hour"))
    for at in range(0, 400, 140):
        s.send(rows[at:at + 140])
    want = {(r["rec_id"], r["ord"]): r["kept"] for r in throttle(spark.createDataFrame(rows, SCHEMA), 250).collect()}
    assert {(r["rec_id"], r["ord"]): r["kept"] for r in s.rows()} == want


def test_expired_throttle_state_changes_no_answer(spark):
    s = Stream(spark, lambda df: throttle_state(df, 250, watermark="0 seconds"))
    s.send([click(1, 0, 5_000_000), click(1, 1, 5_000_100)])
    s.send([click(2, 0, 9_000_000)])  # the watermark passes 5,000,250
    s.send([click(1, 2, 9_000_100), click(1, 3, 9_000_300), click(1, 4, 9_000_350)])
    assert {(r["rec_id"], r["ord"]): r["kept"] for r in s.rows()} == {(1, 0): True, (1, 1): False, (2, 0): True, (1, 2): True, (1, 3): False, (1, 4): True}


def test_long_files_are_answered_unopened(spark):
    root = tempfile.mkdtemp(prefix="uploads-")
    for name, n in (("b", 40), ("c", 41), ("d", 4000)):
        with open(f"{root}/{name}.json", "w") as f:
            f.write("[" + "1" * (n - 2) + "]")
    os.chmod(f"{root}/d.json", 0)
    out = tempfile.mkdtemp(prefix="uploads-")
    run_available(intake(spark, root, most=40), f"{out}/sink", f"{out}/ckpt")
    got = {os.path.basename(r["file"]): (r["status"], r["error"]) for r in spark.read.parquet(f"{out}/sink").collect()}
    assert got == {"b.json": (500, "write failed"), "c.json": (413, "body too large"), "d.json": (413, "body too large")}
    # the reader itself tests the length; the scan for long files has no content
    files = spark.read.format("binaryFile").load(root)
    plan = files.filter(F.col("length") <= 40).select("path", "content")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(length), LessThanOrEqual(length,40)]" in plan


def test_uploads_land_in_one_folder_and_are_listed_by_few_tasks(spark):
    from clickloom.session import LISTING
    from clickloom.sources.payloads import write_uploads
    root = tempfile.mkdtemp(prefix="landing-")
    rows = [(f"page={i}", "[1]") for i in range(60)] + [("page=60", "a"), ("page=60", "a"), ("page=61", None)]
    write_uploads(spark.createDataFrame(rows, "name string, body string").repartition(3), root)
    held = {n: open(f"{root}/{n}").read() for n in os.listdir(root)}
    assert held == {**{f"page={i}.txt": "[1]\n" for i in range(60)}, "page=60.txt": "a\na\n", "page=61.txt": "\n"}
    before = spark.conf.get(LISTING)
    run_available(intake(spark, root), f"{root}-sink", f"{root}-checkpoint")
    assert spark.conf.get(LISTING) == before
    got = spark.read.parquet(f"{root}-sink")
    assert {(r["status"], r["n"]) for r in got.groupBy("status").agg(F.count("*").alias("n")).collect()} == {(500, 60), (400, 2)}
