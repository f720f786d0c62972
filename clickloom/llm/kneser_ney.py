"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

    p(w | h) = max(c(hw) - D(c(hw)), 0) / c(h.) + L(h) p(w)
    p(w)     = max(k(w) - E(k(w)), 0) / K + M / (V + 1)

c(hw): count of the pair; k(w): number of different words before w, K their
sum; D and E: the modified discounts for counts 1, 2 and 3 or more, from the
counts of counts; L and M give out what the discounts took; V + 1: the words
seen and one for all others.  A sentence begins after a start mark and ends
with an end mark, which is a token.  Probabilities of all words after a
context sum to one.

The model lives in files in the shared folder, sorted arrays that scoring
workers map into memory: the vocabulary (64-bit word hashes, a word's id is its
place among them, and counts), the pairs (context id << 32 | word id, and
counts) in shards, and each word's context and continuation figures by id.
Nothing of it passes through the driver but one row a file.

Counting tasks add up their own partition first and send sorted, packed runs,
one a shard, so a hot word is a few entries a task.  Pairs are dealt to shards
by context; contexts with a large share of all tokens also by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from clickloom.llm.common import WordHash, chunks_of_words, materialize, texts_of
from clickloom.llm.files import create, resolve
from clickloom.session import scratch_path

START, END = b"\t", b"\n"  # no words: words hold no white space
#: Tokens that a task counts before it sends what it has.
HELD = 6_000_000
#: Tokens of training text a shard of pairs is made for, at least 16 shards.
SHARD_TOKENS = 1_000_000
#: Vocabulary files, by the top bits of the hash; ids in a file of word figures.
VOCAB_BITS = 6
ID_BLOCK = 1 << 18
KNOWN_IDS = 500_000


def write_arrays(folder: str, name: str, *arrays: np.ndarray) -> str:
    path, stream = create(folder, name)
    with stream:
        for a in arrays:
            stream.write(np.ascontiguousarray(a).view(np.uint8).data if len(a) else b"")
    return path


_MAPPED: dict[str, np.ndarray] = {}


def mapped(path: str, *layout: tuple[str, int]) -> list[np.ndarray]:
    """The arrays of a file: memory-mapped from a mounted folder, else read once a worker."""
    if path not in _MAPPED:
        system, local = resolve(path)
        if system.type_name == "local":
            size = system.get_file_info(local).size
            _MAPPED[path] = np.memmap(local, np.uint8, "r") if size else np.empty(0, np.uint8)
        else:
            _MAPPED[path] = np.frombuffer(system.open_input_file(local).read(), np.uint8)
    raw, at, out = _MAPPED[path], 0, []
    for kind, n in layout:
        size = np.dtype(kind).itemsize * n
        out.append(raw[at:at + size].view(kind))
        at += size
    return out


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted int64 keys and their counts, as compressed byte planes of differences."""
    step = np.diff(keys, prepend=np.int64(0))
    planes = [x.view(np.uint8).reshape(-1, 8).T for x in (step, counts.astype(np.int64))]
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(16, -1)
    step, counts = (np.ascontiguousarray(planes[i:i + 8].T).view(np.int64).ravel() for i in (0, 8))
    return np.cumsum(step), counts


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def runs(keys: np.ndarray, counts: np.ndarray, shards: np.ndarray) -> pa.RecordBatch:
    """One packed run a shard; keys are sorted and distinct."""
    order = np.argsort(shards, kind="stable")
    shards, keys, counts = shards[order], keys[order], counts[order]
    cuts = np.concatenate([[0], np.flatnonzero(shards[1:] != shards[:-1]) + 1, [len(shards)]])
    pairs = [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
    return pa.record_batch({"shard": pa.array([shards[a] for a, _ in pairs], pa.int64()),
                            "run": pa.array([pack(keys[a:b], counts[a:b]) for a, b in pairs], pa.binary())})


def by_shard(batches):
    """Batches of (shard, run), sorted by shard -> (shard, keys, counts) added up."""
    now, held = None, []
    for batch in batches:
        for shard, run in zip(batch.column("shard").to_pylist(), batch.column("run").to_pylist()):
            if shard != now and held:
                yield now, *added(*map(np.concatenate, zip(*held)))
                held = []
            now = shard
            held.append(unpack(run))
            if len(held) >= 64:
                held = [added(*map(np.concatenate, zip(*held)))]
    if held:
        yield now, *added(*map(np.concatenate, zip(*held)))


def vocab_file(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.int64(64 - VOCAB_BITS)) + np.int64(1 << (VOCAB_BITS - 1))


class Vocabulary:
    """word -> id over the mapped files; -1 for a word not in training."""

    def __init__(self, files: list[dict]):
        self.files = {f["shard"]: f for f in files}
        self.size = sum(f["n"] for f in files)
        at, self.first = 0, {}
        for s in sorted(self.files):
            self.first[s] = at
            at += self.files[s]["n"]
        self.known: dict[bytes, int] = {}

    def _each_file(self, order_by: np.ndarray):
        order = np.argsort(order_by, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(order_by[order])) + 1, [len(order)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield order_by[order[a]], order[a:b]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        for s, who in self._each_file(vocab_file(hashes)):
            if f := self.files.get(int(s)):
                have, _ = mapped(f["path"], ("<i8", f["n"]), ("<i8", f["n"]))
                want = hashes[who]
                at = np.minimum(np.searchsorted(have, want), f["n"] - 1)
                out[who] = np.where(have[at] == want, at + self.first[int(s)], -1)
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Token counts of ids (0 for -1)."""
        shards = np.array(sorted(self.files))
        starts = np.array([self.first[s] for s in shards.tolist()])
        out = np.zeros(len(ids), np.int64)
        ok = np.flatnonzero(ids >= 0)
        for k, who in self._each_file(np.searchsorted(starts, ids[ok], side="right") - 1):
            f = self.files[int(shards[k])]
            out[ok[who]] = mapped(f["path"], ("<i8", f["n"]), ("<i8", f["n"]))[1][ids[ok[who]] - starts[k]]
        return out

    def ids(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and each list's length."""
        if len(self.known) > KNOWN_IDS:
            self.known = {}
        new = list(set().union(*lists) - self.known.keys())
        if new:
            h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in new), np.uint64, len(new)).view(np.int64)
            self.known.update(zip(new, self.find(h).tolist()))
        get = self.known.__getitem__
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        out = np.empty(int(n.sum()), np.int64)
        at = 0
        for w in lists:
            out[at:at + len(w)] = np.fromiter(map(get, w), np.int64, len(w))
            at += len(w)
        return out, n


_LOADED: dict[str, object] = {}


def loaded(kind: type, files: list[dict]):
    """This worker's reader of these files; it serves later tasks too."""
    key = f"{kind.__name__}:{files[0]['path'] if files else ''}"
    if key not in _LOADED:
        for old in [k for k in _LOADED if k.startswith(kind.__name__)]:
            del _LOADED[old]
        _LOADED[key] = kind(files)
    return _LOADED[key]


def framed(ids: np.ndarray, n: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of texts with their end marks: (contexts, tokens, texts' first tokens)."""
    ends = np.cumsum(n)
    tokens = np.insert(ids, ends, after)
    contexts = np.insert(ids, np.concatenate([[0], ends[:-1]]) if len(n) else ends, before)
    return contexts, tokens, np.concatenate([[0], np.cumsum(n + 1)[:-1]]) if len(n) else ends


def count_words(train: DataFrame, folder: str) -> list[dict]:
    """Vocabulary files of ``train(text)``: one dict a file."""

    def count(batches):
        word, held, size = WordHash(), [], 0
        start, end = word[START], word[END]
        for batch in batches:
            for _, lists in chunks_of_words(texts_of(batch, "text"), lower=True):
                h, _ = word.of(lists)
                u, c = np.unique(np.concatenate([h, np.full(len(lists), end)]), return_counts=True)
                held.append((np.concatenate([u, [start]]), np.concatenate([c, [0]])))  # a context, never a token
                size += len(h)
                if size >= HELD:
                    k, c = added(*map(np.concatenate, zip(*held)))
                    yield runs(k, c, vocab_file(k))
                    held, size = [], 0
        if held:
            k, c = added(*map(np.concatenate, zip(*held)))
            yield runs(k, c, vocab_file(k))

    def write(batches):
        for shard, keys, counts in by_shard(batches):
            yield pa.RecordBatch.from_pylist([{"shard": shard, "n": len(keys), "types": int((counts > 0).sum()), "tokens": int(counts.sum()),
                                               "path": write_arrays(folder, f"vocab-{shard:04d}", keys, counts)}])

    found = train.mapInArrow(count, "shard long, run binary").repartition("shard").sortWithinPartitions("shard")
    return [r.asDict() for r in materialize(found.mapInArrow(write, "shard long, n long, types long, tokens long, path string")).collect()]  # one row a file


class Pairs:
    """Counts of pairs over the mapped shards."""

    def __init__(self, files: list[dict]):
        self.files = {f["shard"]: f for f in files}

    def counts(self, keys: np.ndarray, shards: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        order = np.lexsort((keys, shards))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards[order])) + 1, [len(order)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a and (f := self.files.get(int(shards[order[a]]))):
                have, c = mapped(f["path"], ("<i8", f["n"]), ("<u4", f["n"]))
                want = keys[order[a:b]]
                at = np.minimum(np.searchsorted(have, want), f["n"] - 1)
                out[order[a:b]] = np.where(have[at] == want, c[at], 0)
        return out


class Figures:
    """By word id: words before it (k), and as a context its tokens and its numbers of pairs seen once, twice, more."""

    LAYOUT = (("<i4", ID_BLOCK), ("<i8", ID_BLOCK), ("<i4", ID_BLOCK), ("<i4", ID_BLOCK), ("<i4", ID_BLOCK))

    def __init__(self, files: list[dict]):
        self.files = {f["shard"]: f for f in files}

    def of(self, ids: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros(len(ids), np.int64) for _ in self.LAYOUT]
        block = np.where(ids >= 0, ids // ID_BLOCK, -1)
        for b in np.unique(block).tolist():
            if f := self.files.get(b):
                who = np.flatnonzero(block == b)
                at = ids[who] - b * ID_BLOCK
                for x, a in zip(out, mapped(f["path"], *self.LAYOUT)):
                    x[who] = a[at]
        return out


def shard_of(keys: np.ndarray, n_shards: int, hot: np.ndarray) -> np.ndarray:
    context, word = keys >> np.int64(32), keys & np.int64(0xFFFFFFFF)
    return (context + np.where(np.isin(context, hot), word, 0)) % np.int64(n_shards)


def discounts(n: list[int]) -> list[float]:
    """For counts 1, 2 and 3 or more, from how many things were counted 1, 2, 3 and 4 times; where those are too few
    for the estimate, 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = n
    out = [0.5, 1.0, 1.5]
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4))):
            if a and 0 < (d := i + 1 - (i + 2) * y * b / a) <= i + 1:
                out[i] = d
    return out


def counts_of_counts(x: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(x, 5), minlength=6)[1:5].tolist()


def taken(c: np.ndarray, d: list[float]) -> np.ndarray:
    """The discount of each count."""
    return np.array([0.0, *d])[np.minimum(c, 3)]


def train_model(train: DataFrame, folder: str) -> dict:
    """Count ``train(text)`` into files; returns the small description that scoring needs."""
    vocab = count_words(train, folder)
    tokens = sum(f["tokens"] for f in vocab)
    size = sum(f["n"] for f in vocab)
    if size >= 1 << 31:
        raise ValueError("more than 2^31 different words: ids no longer fit a pair's key")
    n_shards = max(16, tokens // SHARD_TOKENS)
    least = max(1, tokens // (4 * n_shards))  # at most 4 n_shards words are as frequent

    def frequent(batches):
        v = loaded(Vocabulary, vocab)
        for batch in batches:
            for s in batch.column("shard").to_pylist():
                f = v.files[s]
                hot = np.flatnonzero(mapped(f["path"], ("<i8", f["n"]), ("<i8", f["n"]))[1] >= least)
                yield pa.record_batch({"id": pa.array(hot + v.first[s], pa.int64())})

    spark = train.sparkSession
    listed = spark.createDataFrame([(f["shard"],) for f in vocab], "shard long")
    hot = np.array(sorted(r["id"] for r in listed.mapInArrow(frequent, "id long").collect()), np.int64)

    def count(batches):
        v = loaded(Vocabulary, vocab)
        word = WordHash()
        start, end = v.find(np.array([word[START], word[END]])).tolist()
        held, size = [], 0
        for batch in batches:
            for _, lists in chunks_of_words(texts_of(batch, "text"), lower=True):
                h, w, _ = framed(*v.ids(lists), start, end)
                held.append(np.unique(h << np.int64(32) | w, return_counts=True))
                size += len(w)
                if size >= HELD:
                    k, c = added(*map(np.concatenate, zip(*held)))
                    yield runs(k, c, shard_of(k, n_shards, hot))
                    held, size = [], 0
        if held:
            k, c = added(*map(np.concatenate, zip(*held)))
            yield runs(k, c, shard_of(k, n_shards, hot))

    # what a shard tells: its file, its counts of counts, and runs of figures for blocks of ids
    told = "kind string, shard long, n long, path string, ns array<long>, field int, run binary"
    schema = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("n", pa.int64()), ("path", pa.string()), ("ns", pa.list_(pa.int64())),
                        ("field", pa.int32()), ("run", pa.binary())])

    def write(batches):
        for shard, keys, counts in by_shard(batches):
            path = write_arrays(folder, f"pairs-{shard:05d}", keys, counts.astype(np.uint32))
            rows = [{"kind": "pairs", "shard": shard, "n": len(keys), "path": path, "ns": counts_of_counts(counts)}]
            context, word = keys >> np.int64(32), keys & np.int64(0xFFFFFFFF)
            per_context = [added(context[m], x[m]) for m, x in (
                (slice(None), counts), (counts == 1, np.ones_like(counts)), (counts == 2, np.ones_like(counts)), (counts > 2, np.ones_like(counts)))]
            for field, (ids, n) in enumerate([added(word, np.ones_like(word)), *per_context]):
                if len(ids):
                    t = runs(ids, n, ids // ID_BLOCK)
                    rows += [{"kind": "figures", "shard": s, "field": field, "run": r} for s, r in zip(t.column("shard").to_pylist(), t.column("run").to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema)

    found = materialize(train.mapInArrow(count, "shard long, run binary").repartition("shard").sortWithinPartitions("shard").mapInArrow(write, told))
    pairs = [r.asDict() for r in found.filter("kind = 'pairs'").select("shard", "n", "path", "ns").collect()]  # one row a file

    def gather(batches):
        now, held = None, None

        def done():
            path = write_arrays(folder, f"figures-{now:05d}", *[a.astype(k) for a, (k, _) in zip(held, Figures.LAYOUT)])
            return pa.RecordBatch.from_pylist([{"shard": now, "path": path, "sum": int(held[0].sum()), "ns": counts_of_counts(held[0]),
                                                "more": int((held[0] > 2).sum())}])

        for batch in batches:
            for shard, field, run in zip(*(batch.column(c).to_pylist() for c in ("shard", "field", "run"))):
                if shard != now:
                    if held is not None:
                        yield done()
                    now, held = shard, [np.zeros(ID_BLOCK, np.int64) for _ in Figures.LAYOUT]
                ids, n = unpack(run)
                held[field][ids - shard * ID_BLOCK] += n  # ids are distinct within a run
        if held is not None:
            yield done()

    figures = found.filter("kind = 'figures'").select("shard", "field", "run").repartition("shard").sortWithinPartitions("shard")
    figures = [r.asDict() for r in materialize(figures.mapInArrow(gather, "shard long, path string, sum long, ns array<long>, more long")).collect()]
    add = lambda files: [sum(x) for x in zip(*(f.pop("ns") for f in files))] or [0, 0, 0, 0]
    d, n = discounts(add(pairs)), add(figures)
    e, total = discounts(n), sum(f["sum"] for f in figures)
    given = (e[0] * n[0] + e[1] * n[1] + e[2] * sum(f["more"] for f in figures)) / total if total else 1.0
    return {"vocab": vocab, "pairs": pairs, "figures": figures, "n_shards": n_shards, "hot": hot, "tokens": tokens,
            "types": sum(f["types"] for f in vocab), "D": d, "E": e, "K": total, "M": given}


def word_scores(model: dict, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all tokens of the texts, end marks included: probability, training count; and the texts' first tokens."""
    v, pairs, figures = loaded(Vocabulary, model["vocab"]), loaded(Pairs, model["pairs"]), loaded(Figures, model["figures"])
    word = WordHash()
    start, end = v.find(np.array([word[START], word[END]])).tolist()
    h, w, first = framed(*v.ids(lists), start, end)
    both, back = np.unique(h << np.int64(32) | (w & np.int64(0xFFFFFFFF)), return_inverse=True)
    h, w = both >> np.int64(32), (both & np.int64(0xFFFFFFFF)).astype(np.uint32).view(np.int32).astype(np.int64)
    c = np.zeros(len(both), np.int64)
    ok = np.flatnonzero((h >= 0) & (w >= 0))
    c[ok] = pairs.counts(both[ok], shard_of(both[ok], model["n_shards"], model["hot"]))
    words, at = np.unique(w, return_inverse=True)
    k = figures.of(words)[0]
    p = np.full(len(words), model["M"] / (model["types"] + 1))
    if model["K"]:
        p += np.maximum(k - taken(k, model["E"]), 0) / model["K"]
    p = p[at]
    contexts, at_h = np.unique(h, return_inverse=True)
    _, total, one, two, more = figures.of(contexts)
    d = model["D"]
    left = np.where(total > 0, (d[0] * one + d[1] * two + d[2] * more) / np.maximum(total, 1), 1.0)[at_h]
    p = left * p + np.maximum(c - taken(c, d), 0) / np.maximum(total, 1)[at_h]
    return p[back.ravel()], v.counts(words)[at][back.ravel()], first


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs(doc_id, held_out, text)`` -> the scores of every row; a null text is an empty one (its end mark alone)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names of files, and at most 4 shards' worth of hot ids

    def run(batches):
        model = shared.value
        n_tokens, unit = model["tokens"], np.log10(model["tokens"] + model["types"] + 1)
        for batch in batches:
            for at, lists in chunks_of_words(texts_of(batch, "text"), lower=True):
                p, c, first = word_scores(model, lists)
                n = np.diff(np.concatenate([first, [len(p)]]))
                total = np.add.reduceat(np.log10(p), first)
                part = {x: batch.column(x).slice(at, len(lists)) for x in ("doc_id", "held_out")}
                yield pa.record_batch(part | {
                    "n_tokens": pa.array(n), "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
                    "train_tokens": pa.array(np.full(len(n), n_tokens)), "base_score": pa.array(np.add.reduceat(np.log10(c + 1) - unit, first)),
                    "score": pa.array(total), "perplexity": pa.array(10 ** (-total / n))})

    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows where ``held_out`` (a column over the id) is false and score every row.

    One row per row of ``docs``; null ids and repeated rows stay and count as often as they occur.  With nothing to
    learn from, every token has the probability of an unseen word in an empty vocabulary, 1.  Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out)
    model = train_model(rows.filter(~F.col("held_out")).select("text"), scratch_path(docs.sparkSession, "lm"))
    return score(rows, model)
