from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from clickloom.llm import decontam, mixing, neardup, quality
from .conftest import CLASHING, edge_rows


def as_tables(spark, tmp_path, docs):
    import random
    rng = random.Random(2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(40)] + [(None, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, edge_rows()[7][1]), (1, " ".join(f"q{rng.randrange(99)}" for _ in range(20))), (2, None)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_do_what_their_operators_say(spark, tmp_path, edge):
    sf = as_tables(spark, tmp_path, edge)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    numbers = [3, 2, 9, 6, 5]
    assert len(P.STAGES) == len(numbers)
    for i, (name, stage) in enumerate(P.STAGES):
        before = docs
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        rows = Counter((r.doc_id, r.text) for r in docs.collect())
        was = Counter((r.doc_id, r.text) for r in before.collect())
        assert docs.columns == edge.columns or i == 4
        if i in (0, 2):
            assert rows <= was
        if i == 1:
            kept = neardup.near_duplicates(before).filter("kept").select("doc_id").distinct().collect()
            assert {k for k, _ in rows} == {r.doc_id for r in kept}
            assert all(n == 1 for (k, _), n in rows.items() if k is not None)
            assert sum(n for (k, _), n in rows.items() if k is None) == sum(n for (k, _), n in was.items() if k is None)
        if i == 2:
            bad = {r.doc_id for r in decontam.contaminated(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert {k for k, _ in rows} == {k for k, _ in was} - bad
        if i == 3:
            want = Counter()
            for r in mixing.mix(before).collect():
                want[r.doc_id] += r.copies
            got = Counter()
            for (k, _), n in rows.items():
                got[k] += n
            assert got == +want
        if i == 4:
            assert rows == was
            sizes = Counter(r.shard for r in docs.collect())
            assert max(sizes.values()) - min(sizes[s] for s in range(P.SHARDS)) <= 1
    run = P.run(spark, sf)
    assert Counter((r.doc_id, r.shard, r.slot) for r in run.collect()) == Counter((r.doc_id, r.shard, r.slot) for r in docs.collect())


def test_empty_tables_stay_empty(spark, tmp_path, none):
    sf = as_tables(spark, tmp_path, none)
    assert P.run(spark, sf).count() == 0
