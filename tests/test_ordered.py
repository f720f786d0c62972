import random

from pyspark.sql import functions as F

from clickloom.plans.ordered import add_chunk, dense_ordinal, with_adjacent, with_running


def test_helpers_match_brute_force(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(1, 3), i * 3 + rnd.randint(0, 2), rnd.randint(0, 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "rec bigint, eid bigint, v bigint")
    by = {}
    for rec, eid, v in sorted(rows, key=lambda r: (r[0], r[1])):
        by.setdefault(rec, []).append((eid, v))
    for chunk in (1, 4, 1 << 20):
        d = dense_ordinal(add_chunk(df, "eid", chunk), "rec", "eid", "ord")
        d = with_adjacent(d, prev=["v"], nxt=["v"], keys="rec")
        d = with_running(d, {"cs": (F.col("v"), "sum"), "mx": (F.col("v"), "max")}, keys="rec")
        got = {(r["rec"], r["eid"]): (r["ord"], r["prev_v"], r["next_v"], r["cs"], r["mx"]) for r in d.collect()}
        for rec, evs in by.items():
            cs = mx = 0
            for i, (eid, v) in enumerate(evs):
                cs += v
                mx = max(mx, v)
                want = (i + 1, evs[i - 1][1] if i else None, evs[i + 1][1] if i + 1 < len(evs) else None, cs, mx)
                assert got[(rec, eid)] == want, (chunk, rec, eid)
