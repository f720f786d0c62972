"""Sharding and mixing against their definitions."""
import zlib
from collections import Counter, defaultdict

import pytest

from clickloom.llm import mixing, sharding
from .conftest import edge_rows, tuples


@pytest.mark.parametrize("n", [1, 7, 24, 200])
def test_shards_are_even_gapless_and_stratified(edge, n):
    rows = sharding.interleave(edge, n).collect()
    docs = edge_rows()
    assert len(rows) == len(docs)
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = [len(by[s]) for s in range(n)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))


def test_shards_match_the_mixture(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text", "if(id % 3 = 0, 'hot', if(id % 10 = 1, concat('s', id), concat('m', id % 7))) AS source")
    rows = sharding.interleave(docs, 24).collect()
    share, have = Counter(r.stratum for r in rows), Counter((r.shard, r.stratum) for r in rows)
    for k in range(24):
        for s, total in share.items():
            if total > 100:
                assert abs(have[k, s] - total / 24) <= 3
        small = sum(n for (x, s), n in have.items() if x == k and s[0] == "s")
        assert 2 <= small <= 20  # 200 sources of one row each spread over all shards


def test_shards_repeat_and_stay_empty(edge, none):
    a, b = (tuples(sharding.shard_documents(edge), "doc_id", "shard", "slot", "law", "grown_shard") for _ in range(2))
    assert a == b
    assert sharding.shard_documents(none).count() == 0


def test_sharded_keeps_rows(edge):
    out = sharding.sharded(edge, 5)
    assert Counter((r.doc_id, r.text, r.lang) for r in out.collect()) == Counter((r[0], r[1], r[2]) for r in edge_rows())
    assert out.columns.count("shard") == 1 and set(edge.columns) <= set(out.columns)


def filled(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    """Targets by plain resharing rounds."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= epochs * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_mix_meets_targets(edge):
    rows = mixing.mix(edge).collect()
    assert len(rows) == len(edge_rows())
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken in (0, r["size"], 2 * r["size"])
    want = filled(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    assert tuples(mixing.mix(edge), "doc_id", "taken") == tuples(mixing.mix(edge), "doc_id", "taken")


def test_mix_counts_words_as_bytes_do(edge):
    got = Counter((r.doc_id, r["size"]) for r in mixing.mix(edge).collect())
    assert got == Counter((r[0], len((r[1] or "").encode().split())) for r in edge_rows())


def test_mixed_repeats_whole_rows(edge, none):
    out = mixing.mixed(edge)
    assert out.columns == edge.columns
    want = Counter()
    for r in mixing.mix(edge).collect():
        want[r.doc_id, r.source, r["size"]] += r.copies
    got = Counter((r.doc_id, r.source, len((r.text or "").encode().split())) for r in out.collect())
    assert got == +want
    assert mixing.mixed(none).count() == 0 and mixing.mix(none).count() == 0


def test_sampling_follows_inclusion_odds(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'word' AS text", "if(id < 10000, 'a', 'b') AS source")
    rows = mixing.mix(docs).groupBy("source").sum("taken", "copies").collect()
    got = {r.source: r["sum(taken)"] for r in rows}
    assert got == {"a": 20_000, "b": 10_000}  # 5 : 2 of 30,000, the first at its ceiling
