import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import hard_negatives as hn


def moved():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def brute(rows):
    ok = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, np.floor(np.array(v, float) * 256).astype(np.int64)) for i, lab, v in rows
          if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    wide = max((len(v) for *_, v in ok), default=0)
    ok = [(i, lab, np.pad(v, (0, wide - len(v)))) for i, lab, v in ok]
    anchors, lengths = {}, {}
    for i, lab, v in ok:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (lab, tuple(v))), (lab, tuple(v)))
    out = []
    for a, (lab, v) in anchors.items():
        others = sorted((-int(np.dot(v, x)), i, y) for i, y, x in ok if i != a)
        for s, i, _ in [o for o in others if o[2] == lab][:5]:
            fits = [(j, -t) for t, j, y in others if y != lab and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, i, r + 1, j, -s, t) for r, (j, t) in enumerate(fits)]
    return sorted(out)


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("near", F.lit("clash")).withColumn("norm", F.lit(1)).withColumn("g", F.lit(1))
    got = hn.mine(df.repartition(parts), F.col("vec_id") % 100 == 0, moved())
    return sorted(tuple(r)[:6] for r in got.collect())


def cloud(seed, n, wide=12, centres=6, spread=0.4):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, wide))
    out = []
    for i in range(n):
        v = c[rng.integers(centres)] + spread * rng.standard_normal(wide)
        out.append((i, int(rng.integers(4)), [float(x) for x in v / np.linalg.norm(v)]))
    return out


def test_equals_brute_force_with_edge_rows(spark, monkeypatch):
    rows = cloud(1, 900)
    rows += [(i + 1000, rows[i][1], list(rows[i][2])) for i in range(0, 400, 3)]  # ties
    rows += [(2000, None, [1.0] * 12), (2001, 1, None), (2100, 1, [1.0, None]), (2002, 2, [float("nan")] * 12), (2200, 2, [float("inf")] * 12), (None, 1, [1.0] * 12),
             (2300, 1, []), (2301, 0, [0.0] * 12), (2400, 3, [0.5]), (2500, 2, [float(x) for x in np.linspace(-1, 1, 15)]), (2600, 1, [-x for x in rows[0][2]])]
    want = brute(rows)
    assert len(want) > 300
    assert run(spark, rows) == want
    monkeypatch.setattr(hn, "GROUP", 150)
    monkeypatch.setattr(hn, "ANCHORS", 4)
    monkeypatch.setattr(hn, "DIRECTIONS", 3)
    assert run(spark, rows) == want


def test_repeated_ids(spark):
    rows = cloud(2, 120) + [(5, 1, cloud(3, 1)[0][2]), (100, 0, cloud(4, 1)[0][2]), (100, 3, cloud(5, 1)[0][2])] + [(7, 2, cloud(6, 1)[0][2])] * 8
    assert run(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    assert run(spark, []) == []
    rows = [(100, 1, [1.0, 0.0]), (1, 1, [1.0, 0.1]), (2, 2, [0.5, 0.0])]
    assert run(spark, rows) == brute(rows) == [(100, 1, 1, 2, 256 * 256, 128 * 256)]
    assert run(spark, [(1, 1, [1.0])]) == []


@pytest.mark.parametrize("spread", [0.05, 0.4])
def test_bounds_hold_and_prune(spread):
    rng = np.random.default_rng(3)
    m = np.array([np.floor(256 * np.array(v)) for _, _, v in cloud(7, 2000, 16, 12, spread)]).astype(np.int64)
    norms = np.linalg.norm(m, axis=1)
    units = m[:24] / norms[:24, None]
    angles = hn.angles_to(m, norms, units)
    labels = rng.integers(0, 4, len(m))
    order = np.lexsort((angles.argmin(1),))
    blocks = []
    for at in range(0, len(m), 50):
        x = order[at:at + 50]
        row = {"n": len(x), "ids": x.astype(np.int64).tobytes(), "labels": labels[x].astype(np.int64).tobytes(), "kind": "<i8", "v": m[x].tobytes(),
               "norms": norms[x].tobytes(), "angles": angles[x].tobytes()}
        blocks.append(hn.Block(row, 16))
    a = np.arange(0, 2000, 100)
    for b in blocks:
        got = m[a] @ b.m.T
        high, low = b.bounds(angles[a], norms[a])
        assert (got <= high[:, None]).all() and (got >= low[:, None]).all()
        up, down = b.row_bounds(angles[a], norms[a], np.sin(angles[a]).argmin(1))
        assert (got <= up).all() and (got >= down).all()
    import pyarrow as pa
    t = pa.table({"vec_id": a, "label": labels[a], "v": m[a].tolist(), "norm": norms[a], "angles": [x.tobytes() for x in angles[a]]})
    asked = hn.Asked(t, 16, 5, [[(hn.NONE + 1, hn.LAST)]] * len(a))
    scored, pairs = hn.search_cell(blocks, asked, True)
    assert scored < (0.5 if spread < 0.1 else 1.0) * pairs
    for i, q in enumerate(a):
        want = sorted((-int(m[q] @ m[x]), int(x)) for x in range(2000) if x != q and labels[x] == labels[q])[:5]
        assert [(-s, n) for s, n in zip(asked.scores[i, 0].tolist(), asked.names[i, 0].tolist())] == want
