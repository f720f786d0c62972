import numpy as np
from pyspark.sql import functions as F

from clickloom.llm import topk


def brute(rows, k=5):
    ok = [(i, np.floor(np.array(v, float) * 256).astype(np.int64)) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    wide = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.pad(v, (0, wide - len(v)))) for i, v in ok]
    first = {}
    for i, v in ok:
        first[i] = min(first.get(i, tuple(v)), tuple(v))
    out = []
    for q in sorted(i for i in first if i % 50 == 0):
        found = sorted((-int(np.dot(first[q], v)), i) for i, v in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("near", F.lit("clash")).withColumn("v", F.lit(1))
    return sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0).collect()))


def test_equals_brute_force_with_edge_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(24)]) for i in range(700)]
    rows += [(i + 1000, list(rows[i][1])) for i in range(0, 300, 3)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")]), (2003, [float("inf")] * 24), (None, [1.0] * 24),
             (2050, []), (2100, [0.5]), (2101, [float(x) for x in rng.standard_normal(30)]), (50, list(rows[50][1])), (100, [9.0] * 24)]
    assert run(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (7, [1.0, -1.0])]
    assert run(spark, rows) == brute(rows) == [(0, 1, 7, -256 * 256)]
    assert run(spark, []) == []


def test_bounds_prune_and_change_nothing():
    rng = np.random.default_rng(2)
    centres = rng.integers(-300, 300, (40, 16))
    blocks = [(np.arange(b * 64, b * 64 + 64), centres[b] + rng.integers(-9, 9, (64, 16))) for b in range(40)]
    queries = np.concatenate([blocks[b][1][:2] for b in range(0, 40, 4)])
    ids = np.concatenate([blocks[b][0][:2] for b in range(0, 40, 4)])
    best, named, scored = topk.search_cell(ids, queries, blocks, 5)
    assert scored < 0.5 * len(queries) * len(blocks)
    for q, i, s, n in zip(queries, ids, best, named):
        want = sorted((-int(q @ v), int(j)) for js, m in blocks for j, v in zip(js, m) if j != i)[:5]
        assert [(-a, b) for a, b in zip(s.tolist(), n.tolist())] == want


def test_large_integers_stay_exact():
    q, m = np.array([[1 << 30, 1]]), np.array([[1 << 30, 1], [1 << 30, 2]])
    best, named, _ = topk.search_cell(np.array([9]), q, [(np.array([1, 2]), m)], 2)
    assert best.tolist() == [[(1 << 60) + 2, (1 << 60) + 1]] and named.tolist() == [[2, 1]]
