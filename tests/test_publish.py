"""Publishing as sets: all or nothing, one winner, names of any kind.  Folder names across batches."""
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from clickloom.sources import publish as P
from clickloom.sources.payloads import assign_dirs, free_dir_names

DOC = "doc bigint, scope string, name string, text string"


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="pub-")  # there, and empty


def there(spark, root, part="docs"):
    rows = P.read_published(spark, root, part)
    return {} if rows is None else {(r["scope"], r["name"]): r["text"] for r in rows.collect()}


def test_numeric_names_and_an_empty_root(spark, root):
    docs = lambda *rows: spark.createDataFrame(rows, DOC)
    plan = P.publish(docs((1, "user", "007", "bond"), (2, "user", "7", "seven")), root)
    assert {r["action"] for r in plan.collect()} == {"created"}
    plan = P.publish(docs((3, "user", "abc", "x"), (4, "user", "7", "again"), (5, "user", "07", "y")), root)
    assert [r["action"] for r in plan.orderBy("doc").collect()] == ["created", "conflict", "created"]
    assert there(spark, root) == {("user", "007"): "bond", ("user", "7"): "seven", ("user", "abc"): "x", ("user", "07"): "y"}
    assert {d for d in os.listdir(f"{root}/scope=user") if d[0] == "n"} == {"name=007", "name=7", "name=07", "name=abc"}


def test_parts_are_of_the_set(spark, root):
    docs = spark.createDataFrame([(1, "user", "a", "one"), (2, "user", "a", "two"), (3, "project", "a", "three")], DOC)
    shots = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r"), (3, "s"), (9, "t")], "doc bigint, text string")
    P.publish(docs, root, parts={"screenshots": shots})
    got = sorted((r["doc"], r["text"]) for r in P.read_published(spark, root, "screenshots").collect())
    assert got == [(1, "p"), (1, "q"), (3, "s")]
    P.publish(docs.filter("doc = 2"), root, overwrite=True, parts={"screenshots": shots})
    got = sorted((r["doc"], r["text"]) for r in P.read_published(spark, root, "screenshots").collect())
    assert got == [(2, "r"), (3, "s")]  # the old set's parts went with its document


@pytest.mark.parametrize("step", ["parts", "entries", "commit"])
def test_a_crash_between_writes_leaves_no_half_set(spark, root, monkeypatch, step):
    docs = spark.createDataFrame([(1, "user", "a", "one")], DOC)
    shots = spark.createDataFrame([(1, "p")], "doc bigint, text string")
    with monkeypatch.context() as m:
        if step == "commit":
            m.setattr(P, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
            bad = {"screenshots": shots}
        elif step == "entries":
            bad = {"screenshots": shots, "report": shots.withColumn("x", F.expr("raise_error('dies')"))}
        else:
            bad = {"report": shots.withColumn("x", F.expr("raise_error('dies')")), "screenshots": shots}
        with pytest.raises(BaseException):
            P.publish(docs, root, parts=bad)
    assert there(spark, root) == {} and there(spark, root, "screenshots") == {}
    assert not os.path.exists(f"{root}/scope=user")
    assert [r["action"] for r in P.publish(docs, root, parts={"screenshots": shots}).collect()] == ["created"]


def test_two_writers_on_one_state_cannot_both_win(spark, root, monkeypatch):
    mine, other = (spark.createDataFrame([(d, "user", "a", t), (d + 1, "user", t, t)], DOC) for d, t in ((1, "mine"), (5, "other")))
    commit, raced = P.commit, []

    def late(spark_, root_, number, set_id):
        if not raced:  # between this writer's plan and its commit another one publishes
            raced.append(1)
            assert P.publish(other, root).count() == 2
        return commit(spark_, root_, number, set_id)

    monkeypatch.setattr(P, "commit", late)
    plan = P.publish(mine, root)
    assert [r["action"] for r in plan.orderBy("doc").collect()] == ["conflict", "created"]
    assert there(spark, root) == {("user", "a"): "other", ("user", "other"): "other", ("user", "mine"): "mine"}


def test_a_writer_that_died_in_the_log_or_after_it(spark, root):
    docs = lambda *rows: spark.createDataFrame(rows, DOC)
    P.publish(docs((1, "user", "a", "one")), root)
    open(f"{root}/_log/{2:010d}", "w").close()  # died while it wrote its log file
    P.publish(docs((2, "user", "b", "two")), root)
    assert [n for n, s in P.log(spark, root) if s] == [1, 3] and set(there(spark, root)) == {("user", "a"), ("user", "b")}
    os.rmdir(f"{root}/_shown/3")  # died before the plain folders were brought up to date
    P.refresh(spark, root)
    assert sorted(r["text"] for r in spark.read.parquet(root).collect()) == ["one", "two"]


def starts(spark, rows):
    return spark.createDataFrame(rows, "arrival long, sec long").withColumn("started_at", F.timestamp_seconds("sec"))


def test_smallest_free_numbers(spark):
    rnd = random.Random(6)
    base = lambda s: f"browser-19700101T0000{s:02d}"
    taken = {(s, n) for s in range(4) for n in rnd.sample(range(60), 25)} | {(7, 0)}
    rows = [(i, rnd.randrange(6)) for i in range(200)]
    df = spark.createDataFrame([(base(s), n) for s, n in taken], "base string, number long")
    got = {r["arrival"]: r["dir_name"] for r in free_dir_names(starts(spark, rows), df).collect()}
    for sec in range(6):
        free = (n for n in range(10_000) if (sec, n) not in taken)
        for i, _ in sorted(r for r in rows if r[1] == sec):
            n = next(free)
            assert got[i] == (f"{base(sec)}-{n}" if n else base(sec))
    assert free_dir_names(starts(spark, []), df).count() == 0


def test_batches_share_a_registry(spark):
    registry = tempfile.mkdtemp(prefix="names-") + "/taken"
    names = lambda df: [r["dir_name"] for r in df.orderBy("arrival").collect()]
    b = "browser-19700101T000005"
    assert names(assign_dirs(starts(spark, [(1, 5), (2, 5)]), registry, 0)) == [b, b + "-1"]
    assert names(assign_dirs(starts(spark, [(3, 5), (4, 6)]), registry, 1)) == [b + "-2", "browser-19700101T000006"]
    again = assign_dirs(starts(spark, [(3, 5), (4, 6)]), registry, 1)  # the batch runs once more
    assert names(again) == [b + "-2", "browser-19700101T000006"]
    assert names(assign_dirs(starts(spark, [(5, 5)]), registry, 2)) == [b + "-3"]


def test_folders_of_targets_are_written_by_many_tasks(spark, tmp_path):
    from clickloom.sources.publish import publish
    docs = spark.range(64).select(F.col("id").alias("doc"), F.lit("user").alias("scope"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("name"))
    publish(docs.coalesce(1), str(tmp_path))
    made = list(tmp_path.glob("scope=user/name=*/part-*.parquet"))
    assert len(made) == 64
    assert len({p.name.split("-")[1] for p in made}) > 4  # a task's number is in its files' names
