"""Near-duplicate classes by MinHash bands and odd sketches.

A document's set holds its distinct 5-word shingles.  128 MinHash samples give
32 bands of 4, in which a pair at similarity 0.75 meets with probability
1 - 5e-6, and an odd sketch: each (sample number, minimum) flips one bit of 512,
so the bits in which two sketches differ, z, estimate the similarity as
1 + ln(1 - 2z/512) for high similarities.  Pairs of a bucket with more than
``MAX_XOR`` differing bits (over four standard deviations off at 0.75) are out;
the others are confirmed on the full sets.

Not all pairs are looked at one by one:

1. equal texts (word sequences) fall together first, by a 128-bit hash;
2. each bucket proposes a spanning forest of its pairs below ``MAX_XOR``; the
   components of all forests are families: every pair that meets in a band and
   passes the sketch lies inside one family;
3. a family's full sets meet in one task, where all its pairs are compared
   exactly at once (products of 0/1 matrices over the shingles that occur
   twice).  A family over ``BLOCK`` documents is cut into blocks, compared block
   against block; before that its forest's best pairs are confirmed, and blocks
   that lie in one and the same class already are not compared.

So no link between classes is lost, copies are never expanded into pairs, and
only links that join classes leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from clickloom.llm.common import WordHash, chunks_of_words, materialize, mix64, rolling, stored, texts_of
from clickloom.llm.components import components
from clickloom.llm.sharding import numbered
from clickloom.session import delete_path

SHINGLE = 5
SAMPLES, BANDS = 128, 32
BITS = 512
MAX_XOR = 100
#: Members of a bucket that one forest is made of, and documents of a family compared with each other in one task.
BUCKET = 2048
BLOCK = 512
#: Shingles multiplied at a time.
WIDE = 4096

_luck = np.random.default_rng(20240229)
FACTOR = (_luck.integers(0, 1 << 31, SAMPLES).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
SHIFT = _luck.integers(0, 1 << 32, SAMPLES).astype(np.uint32)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The distinct shingles (sorted uint64) of a word sequence; the whole sequence, if it is shorter."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(rolling(hashes, min(SHINGLE, len(hashes)), seed=min(SHINGLE, len(hashes))))


def minima(x: np.ndarray) -> np.ndarray:
    """128 MinHash samples (uint32) of a non-empty set of uint64."""
    x = (x >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        part = x[at:at + 4096]
        best = np.minimum(best, (FACTOR[:, None] * part[None, :] + SHIFT[:, None]).min(1))
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    """[documents, 128] -> [documents, 32] bucket keys (int64)."""
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    part = samples.reshape(-1, BANDS, SAMPLES // BANDS).astype(np.uint64)
    for j in range(part.shape[2]):
        key = mix64(key ^ part[:, :, j])
    return key.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """[documents, 128] -> [documents, 64] bytes of parity bits."""
    at = mix64(samples.astype(np.uint64) | (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))[None, :]) % np.uint64(BITS)
    flat = at.astype(np.int64) + np.arange(len(samples))[:, None] * BITS
    odd = np.bincount(flat.ravel(), minlength=len(samples) * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(samples), BITS), axis=1)


def similarity_of_sketches(z: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches that differ in z bits."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * z / BITS, 1e-9))


def _signatures(batches):
    word = WordHash()
    for batch in batches:
        ids = batch.column("doc_id")
        for first, lists in chunks_of_words(texts_of(batch, "text"), lower=True):
            hashes, n = word.of(lists)
            ends = np.cumsum(n)
            samples = np.full((len(lists), SAMPLES), 0xFFFFFFFF, np.uint32)
            sizes = np.zeros(len(lists), np.int64)
            for i, (e, k) in enumerate(zip(ends.tolist(), n.tolist())):
                if k:
                    x = shingles(hashes[e - k:e])
                    sizes[i] = len(x)
                    samples[i] = minima(x)
            keys, odd = band_keys(samples), odd_sketches(samples)
            content = [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in lists]
            yield pa.record_batch({
                "doc_id": ids.slice(first, len(lists)), "n_shingles": pa.array(sizes), "content": pa.array(content, pa.binary()),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())),
                "sketch": pa.array([r.tobytes() for r in odd], pa.binary())})


def _sets(batches):
    word = WordHash()
    for batch in batches:
        for first, lists in chunks_of_words(texts_of(batch, "text"), lower=True):
            hashes, n = word.of(lists)
            ends = np.cumsum(n)
            found = [shingles(hashes[e - k:e]).view(np.int64) for e, k in zip(ends.tolist(), n.tolist())]
            at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.record_batch({"id": batch.column("id").slice(first, len(lists)),
                                   "x": pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found)))})


def _forest(s: np.ndarray) -> list[tuple[int, int, int]]:
    """Pairs (i, j, z) of a minimum spanning forest over sketch distances up to MAX_XOR."""
    n, out = len(s), []
    best, via = np.full(n, BITS + 1, np.int32), np.zeros(n, np.int64)
    left = np.ones(n, bool)
    now = 0
    for _ in range(n):
        left[now] = False
        z = np.bitwise_count(s ^ s[now]).sum(1, dtype=np.int32)
        closer = left & (z < best)
        best[closer], via[closer] = z[closer], now
        rest = np.where(left, best, BITS + 2)
        now = int(rest.argmin())
        if rest[now] > BITS + 1:
            break
        if rest[now] <= MAX_XOR:
            out.append((int(via[now]), now, int(rest[now])))
    return out


def _runs(batches, keys: list[str]):
    """Whole runs of equal keys from batches sorted by them."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not t.num_rows:
            continue
        key = np.stack([t.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1
        if len(cuts):  # the last run may go on in the next batch
            yield t.slice(0, cuts[-1]), np.concatenate([[0], cuts])
        held = t.slice(cuts[-1] if len(cuts) else 0)
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _propose(batches):
    """Buckets (key, parts i and j) -> the pairs of their spanning forests."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("z", pa.int32())])
    for t, starts in _runs(batches, ["key", "i", "j"]):
        ids = t.column("id").to_numpy()
        s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        z = np.bitwise_count(s[two] ^ s[two + 1]).sum(1, dtype=np.int32)
        found = {(min(ids[x], ids[x + 1]), max(ids[x], ids[x + 1]), d) for x, d in zip(two[z <= MAX_XOR].tolist(), z[z <= MAX_XOR].tolist())}
        for x, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own = ids[x:x + n]
            found.update((min(own[i], own[j]), max(own[i], own[j]), d) for i, j, d in _forest(s[x:x + n]))
        if found:
            a, b, z = zip(*found)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(z, pa.int32())], schema=schema)


def _compare(batches, percent: int):
    """Block pairs (family, i, j) with their documents' sets -> links that join different classes."""
    for t, starts in _runs(batches, ["family", "i", "j"]):
        ids, classes, blocks = (t.column(c).to_numpy() for c in ("id", "class", "blk"))
        i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
        lists = t.column("x").combine_chunks()
        n = lists.value_lengths().to_numpy()
        ends, flat = np.cumsum(n), lists.flatten().to_numpy()
        out = []
        for at, to in zip(starts[:-1].tolist(), starts[1:].tolist()):
            x = flat[ends[at] - n[at]:ends[to - 1]]
            left = np.flatnonzero(blocks[at:to] == i[at])
            right = left if i[at] == j[at] else np.flatnonzero(blocks[at:to] == j[at])
            out += _links(x, n[at:to], left, right, ids[at:to], classes[at:to], percent)
        yield pa.record_batch({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _links(x: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray, classes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    owner = np.repeat(np.arange(len(n)), n)
    values, at, times = np.unique(x, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    column = column[at]
    order = np.argsort(column, kind="stable")[np.count_nonzero(column < 0):]
    column, owner = column[order], owner[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(shared), WIDE):
        part = slice(*np.searchsorted(column, [low, low + WIDE]))
        m = np.zeros((len(n), min(WIDE, len(shared) - low)), np.float32)
        m[owner[part], column[part] - low] = 1
        both += m[left] @ m[right].T  # counts below 2^24: exact
    both = both.astype(np.int64)
    linked = 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
    p, q = np.nonzero(linked & (classes[left][:, None] != classes[right][None, :]))
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while c in root:
            c = root[c]
        return c

    out = []
    for a, b in zip(left[p].tolist(), right[q].tolist()):
        c, d = find(int(classes[a])), find(int(classes[b]))
        if c != d:
            root[max(c, d)] = min(c, d)
            out.append((int(ids[a]), int(ids[b])))
    return out


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` with ``linked``: whether 100 x intersection >= percent x union of the full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("x").alias("xa"))
    right = sets.select(F.col("id").alias("b"), F.col("x").alias("xb"))
    n = F.size(F.array_intersect("xa", "xb"))
    linked = 100 * n >= percent * (F.size("xa") + F.size("xb") - n)
    return materialize(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", linked.alias("linked")))


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Words are lower-cased in A-Z.  With fewer than five words the sequence is the one shingle; without words or
    text the set is empty and the row is its own class.  Rows without id link with nothing, have a null class and
    are kept.  Repeated rows (equal ids) get the class of their text.  Empty tables give empty results; other columns
    aren't read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed, signed_at = stored(base.mapInArrow(_signatures, "doc_id long, n_shingles long, content binary, bands array<long>, sketch binary"), "minhash")
    known = signed.filter(F.col("content").isNotNull() & F.col("doc_id").isNotNull())
    # equal texts have equal signatures: any of them will do.  An id that repeats with several texts stands for the first
    reps, reps_at = stored(known.groupBy("content").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "texts")
    texts = reps.select("content", "id")
    keyed = reps.select("id", F.explode("bands").alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    # a bucket over BUCKET members goes part against part: the forests of all pairs of parts hold the bucket together
    parts = F.ceil(F.col("n") / BUCKET)
    meet = keyed.join(full, "key").join(reps.select("id", "sketch"), "id").withColumn("own", F.pmod(F.xxhash64("id"), parts))
    meet = meet.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    meet = meet.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "sketch")
    meet = meet.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    forest = materialize(meet.mapInArrow(_propose, "a long, b long, z int").groupBy("a", "b").agg(F.min("z").alias("z")))
    wanted = forest.select(F.col("a").alias("id")).union(forest.select("b")).distinct()
    family = components(forest.select("a", "b"))
    family = materialize(wanted.join(family, "id", "left").select("id", F.coalesce("component", "id").alias("family")))
    sets, sets_at = stored(base.withColumnRenamed("doc_id", "id").join(family.select("id"), "id", "left_semi").dropDuplicates(["id"])
                           .mapInArrow(_sets, "id long, x array<long>"), "sets")

    classes = None
    large = family.groupBy("family").count().filter(F.col("count") > BLOCK).select("family")
    if not large.isEmpty():
        edges = forest.join(family.select(F.col("id").alias("a"), "family"), "a").join(large, "family", "left_semi")
        ends = edges.select(F.col("a").alias("id"), "a", "b", "z").unionByName(edges.select(F.col("b").alias("id"), "a", "b", "z"))
        best = ends.groupBy("id").agg(F.min(F.struct("z", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        classes = components(_confirm(best, sets, percent).filter("linked"))
        family = family.join(classes, "id", "left").select("id", "family", F.coalesce("component", "id").alias("class"))
    else:
        family = family.withColumn("class", F.col("id"))
    # documents of one class side by side, so that blocks within it can be left out
    spread = F.pmod(F.hash("class"), F.lit(64)) * 64 + F.pmod(F.hash("id"), F.lit(64))
    family = numbered(family.withColumn("bin", spread), ["family"], "bin", [F.col("class"), F.col("id")], "pos")
    family = materialize(family.select("family", F.expr(f"pos div {BLOCK}").alias("blk"), "id", "class"))
    blocks = family.groupBy("family", "blk").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    second = blocks.select("family", F.col("blk").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = blocks.withColumnRenamed("blk", "i").join(second, "family").filter(
        (F.col("i") <= F.col("j")) & (F.least("lo", "lo2") < F.greatest("hi", "hi2")))
    pairs = pairs.select("family", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("blk"))
    work = pairs.join(family, ["family", "blk"]).join(sets, "id").select("family", "i", "j", "blk", "id", "class", "x")
    work = work.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "id")
    links = work.mapInArrow(lambda batches: _compare(batches, percent), "a long, b long")
    if classes is not None:
        links = links.unionByName(classes.select(F.col("id").alias("a"), F.col("component").alias("b")))
    classes = components(links)

    out = (signed.select("doc_id", "n_shingles", "content").join(texts, "content", "left").join(classes, "id", "left")
           .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id")))
           .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))
    out = materialize(out)  # before the files go
    for path in (signed_at, reps_at, sets_at):
        delete_path(spark, path)
    return out
