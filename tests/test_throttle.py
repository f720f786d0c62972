import random

from pyspark.sql import functions as F

import pytest

from clickloom.operators import compact
from clickloom.operators.compact import throttle
from clickloom.plans.ordered import add_chunk


def test_throttle_matches_fold(spark):
    """Times may go back: order is ``ord``."""
    rnd = random.Random(2)
    rows, t = [(9, 0, 1000), (9, 1, 500), (9, 2, 800), (9, 3, 1300)], {}
    for i in range(300):
        rec = rnd.randint(1, 3)
        t[rec] = t.get(rec, 1000) + rnd.choice([-900, -200, 50, 100, 200, 300, 1000])
        rows.append((rec, i, t[rec]))
    df = spark.createDataFrame(rows, "rec_id bigint, ord bigint, ts_ms bigint")
    want = set()
    for rec in {r[0] for r in rows}:
        last = 0
        for _, o, ts in sorted([r for r in rows if r[0] == rec], key=lambda r: r[1]):
            if ts - last >= 250:
                last = ts
                want.add((rec, o))
    for chunk in (1, 5, 1 << 20, None):
        got = throttle(df if chunk is None else add_chunk(df, "ord", chunk), 250).filter("kept").collect()
        assert {(r["rec_id"], r["ord"]) for r in got} == want


def fold(rows, gap):
    kept, last = set(), {}
    for rec, o, ts in sorted(rows):
        if ts - last.get(rec, 0) >= gap:
            last[rec] = ts
            kept.add((rec, o))
    return kept


def flags(df, gap):
    return {(r["rec_id"], r["ord"]): r["kept"] for r in throttle(df, gap).collect()}


@pytest.mark.parametrize("gap", [1, 7, 250])
def test_long_bursts_in_blocks(spark, monkeypatch, gap):
    """Bursts above the array bound: dense and thin ones, times going back, negative and small times."""
    monkeypatch.setattr(compact, "FOLD", 5)
    rnd = random.Random(gap)
    rows = []
    for rec, steps in enumerate([[1], [0, 1, 2], [gap - 1 or 1], [1, gap // 2, gap, -3 * gap], [gap // 3, gap - 1, -gap], [-5, 3, 4]]):
        t = rnd.choice([-3 * gap, 0, gap - 1, 1_700_000_000_000])
        for i in range(rnd.randrange(150, 400)):
            t += rnd.choice(steps)
            rows.append((rec, i, t))
    df = spark.createDataFrame(rows, "rec_id bigint, ord bigint, ts_ms bigint").repartition(3)
    want = fold(rows, gap)
    got = flags(df, gap)
    assert len(got) == len(rows) and {k for k, v in got.items() if v} == want
    assert {k for k, v in flags(add_chunk(df, "ord", 50), gap).items() if v} == want


def test_a_hot_burst_runs_in_many_tasks_without_python(spark, monkeypatch):
    """One recording, no pause in it: rows of every round are spread by (burst, block)."""
    n = 60_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("rec_id"), F.col("id").alias("ord"), (F.lit(10_000) + F.col("id") * 7).alias("ts_ms"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seen = []
        written = compact._written
        monkeypatch.setattr(compact, "_written", lambda x: seen.append(written(x)) or seen[-1])
        out = throttle(df, 250)
        assert "Python" not in out._jdf.queryExecution().toString() and "Pandas" not in out._jdf.queryExecution().toString()
        kept = out.filter("kept").count()
        files = [len(x.inputFiles()) for x in seen[:3]]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert kept == len(fold([(1, i, 10_000 + i * 7) for i in range(n)], 250)) and min(files) >= 3
    with pytest.raises(ValueError):
        throttle(df, 0)
