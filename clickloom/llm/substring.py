"""Removal of repeated passages by suffix automata of reference shards.

A window is ``window`` consecutive words of a document; every word covered by
a window that also starts anywhere else goes.

Equal windows have the same anchor: the leftmost smallest hash among their
``GRAM``-word runs, at the same place in the window.  Consecutive windows of one
anchor form a segment, the words they cover.

1. Anchors are counted over all documents; those that occur once are out, and
   with them every window around them.
2. The segments of repeated anchors are the reference.  They are dealt to
   shards by anchor, equal segments of a task merged with their number.
3. A shard builds a suffix automaton of each anchor's segments and streams the
   segments through it: the matching statistics, cut to the window's length,
   give the state of every window, and a state that ends at two places or
   more marks the window as repeated.  The marks go to files by segment hash.
4. Documents look their segments up and drop the words under marked windows:
   the maximal spans above the threshold.

Automata grow with the corpus, so they aren't broadcast: segments come to the
automaton of their shard, and the marks (sorted arrays, 12 bytes a marked
segment) are mapped into memory from the shared folder.  Texts are never
shuffled; the documents are scanned three times.

An anchor with over ``HOT`` occurrences, such as one in a passage that very
many documents share, is dealt window by window instead, by the window's own
hash; equal windows still meet, and no shard gets all of its segments.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from clickloom.llm.common import WordHash, chunks_of_words, materialize, rolling, texts_of
from clickloom.llm.kneser_ney import added, by_shard, loaded, mapped, runs, write_arrays
from clickloom.session import scratch_path

WINDOW = 35
GRAM = 8
HOT = 4096
ANCHOR_BITS = 6
#: Anchor hashes a task counts before it sends what it has.
HELD = 3_000_000
#: Occurrences of repeated anchors a shard is made for, at least 16 shards.
SHARD_SEGMENTS = 50_000
#: Bytes of segments a task gathers before it sends what it has.
SEGMENT_BYTES = 48 << 20


def anchors(hashes: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: (anchor hash as int64, first window start, windows)."""
    empty = np.empty(0, np.int64)
    grams = rolling(hashes, min(GRAM, window))
    wide = window - min(GRAM, window) + 1
    n = len(hashes) - window + 1
    if n <= 0:
        return empty, empty, empty
    place = np.empty(n, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, wide)
    for at in range(0, n, 1 << 16):
        place[at:at + (1 << 16)] = view[at:at + (1 << 16)].argmin(1)
    place += np.arange(n)
    ends = np.repeat(np.cumsum(lengths), lengths)[:n]
    valid = np.flatnonzero(np.arange(n) + window <= ends)
    if not len(valid):
        return empty, empty, empty
    first = np.flatnonzero(np.concatenate([[True], place[valid[1:]] != place[valid[:-1]]]))
    return grams[place[valid[first]]].view(np.int64), valid[first], np.diff(np.concatenate([first, [len(valid)]]))


def anchor_file(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.int64(64 - ANCHOR_BITS)) + np.int64(1 << (ANCHOR_BITS - 1))


class Sorted:
    """Sorted int64 keys with a small unsigned value, in mapped files by shard; 0 for a key that isn't there."""

    KIND = "<u4"

    def __init__(self, files: list[dict]):
        self.files = {f["shard"]: f for f in files}

    def of(self, keys: np.ndarray, shards: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        order = np.lexsort((keys, shards))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards[order])) + 1, [len(order)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a and (f := self.files.get(int(shards[order[a]]))) and f["n"]:
                have, value = mapped(f["path"], ("<i8", f["n"]), (self.KIND, f["n"]))
                want = keys[order[a:b]]
                at = np.minimum(np.searchsorted(have, want), f["n"] - 1)
                out[order[a:b]] = np.where(have[at] == want, value[at], 0)
        return out


class Repeated(Sorted):
    """Anchors that occur more than once: 1, or 2 for hot ones."""


class Marks(Sorted):
    """Segments with repeated windows: one bit a window."""


def group_hash(text: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def segments(words: list[bytes], runs_of: list[tuple[int, int, int, int]], window: int):
    """(group, text, first window, windows) of a document's runs (anchor, first, windows, 1 or 2)."""
    for anchor, first, n, how in runs_of:
        if how == 1:
            yield anchor, b" ".join(words[first:first + n + window - 1]), first, n
        else:
            for i in range(first, first + n):
                text = b" ".join(words[i:i + window])
                yield group_hash(text), text, i, 1


def documents(texts: list[bytes], repeated: list[dict], window: int):
    """(index of the text, words, runs around repeated anchors) of each text."""
    word, known = WordHash.shared(), loaded(Repeated, repeated)
    for at, lists in chunks_of_words(texts, lower=False, most=500_000):
        h, n = word.of(lists)
        anchor, first, count = anchors(h, n, window)
        how = known.of(anchor, anchor_file(anchor))
        keep = np.flatnonzero(how)
        starts = np.cumsum(n) - n
        # the last text that begins at or before the window holds it; empty ones share their start with the next
        owner = np.searchsorted(starts, first[keep], side="right") - 1
        mine = defaultdict(list)
        for x, d in zip(keep.tolist(), owner.tolist()):
            mine[d].append((int(anchor[x]), int(first[x] - starts[d]), int(count[x]), int(how[x])))
        for i, words in enumerate(lists):
            yield at + i, words, mine.get(i, [])


def pack_segments(rows: list[tuple[int, bytes, int]]) -> bytes:
    """(group, text, number) rows as one compressed run."""
    head = np.array([(g, m, len(t)) for g, t, m in rows], np.int64).reshape(-1, 3)
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(rows)).tobytes() + head.T.tobytes() + b"".join(t for _, t, _ in rows))


def unpack_segments(run: bytes):
    raw = zstandard.ZstdDecompressor().decompress(run)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    groups, numbers, sizes = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n).tolist()
    at = 8 + 24 * n
    for g, m, k in zip(groups, numbers, sizes):
        yield g, raw[at:at + k], m
        at += k


class Automaton:
    """Suffix automaton of several word sequences, with the number of places each state ends at."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len, self.count = [-1], [0], [0]

    def _clone(self, p: int, c: bytes, q: int) -> int:
        new = len(self.len)
        self.next.append(self.next[q].copy())
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.count.append(0)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _extend(self, last: int, c: bytes) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        new = len(self.len)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        self.count.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return new

    def add(self, words: list[bytes], number: int) -> None:
        """``number`` equal sequences."""
        last = 0
        for c in words:
            last = self._extend(last, c)
            self.count[last] += number

    def close(self) -> None:
        """Pass the numbers of places on to suffixes; after the last ``add``."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[v] >= 0:
                self.count[self.link[v]] += self.count[v]

    def repeated(self, words: list[bytes], window: int) -> int:
        """Stream an added sequence: bit i is set if window i ends at two places or more."""
        follow, link, size, count = self.next, self.link, self.len, self.count
        v, out = 0, 0
        for i, c in enumerate(words):
            v = follow[v][c]
            while size[link[v]] >= window:
                v = link[v]
            if i >= window - 1 and count[v] > 1:
                out |= 1 << (i - window + 1)
        return out


def marks_of(found: dict[bytes, int], window: int) -> dict[bytes, int]:
    """Distinct segments of a group with their numbers -> the marked ones' bits."""
    if len(found) == 1:
        (text, number), = found.items()
        return {text: (1 << (text.count(b" ") + 2 - window)) - 1} if number > 1 else {}
    automaton, lists = Automaton(), [(t, t.split(b" "), m) for t, m in found.items()]
    for _, words, m in lists:
        automaton.add(words, m)
    automaton.close()
    return {t: bits for t, words, _ in lists if (bits := automaton.repeated(words, window))}


def repeated_anchors(rows: DataFrame, folder: str, window: int) -> list[dict]:
    """Files of the anchors that occur more than once in ``rows(text)``: one dict a file."""

    def count(batches):
        word, held, size = WordHash.shared(), [], 0

        def sent():
            k, c = added(*map(np.concatenate, zip(*held)))
            return runs(k, c, anchor_file(k))

        for batch in batches:
            for _, lists in chunks_of_words(texts_of(batch, "text"), lower=False, most=500_000):
                a, _, _ = anchors(*word.of(lists), window)
                held.append(np.unique(a, return_counts=True))
                size += len(a)
                if size >= HELD:
                    yield sent()
                    held, size = [], 0
        if size:
            yield sent()

    def write(batches):
        for shard, keys, counts in by_shard(batches):
            keep = counts > 1
            path = write_arrays(folder, f"anchors-{shard:04d}", keys[keep], np.where(counts[keep] > HOT, 2, 1).astype("<u4"))
            yield pa.RecordBatch.from_pylist([{"shard": shard, "n": int(keep.sum()), "places": int(counts[keep].sum()), "path": path}])

    found = rows.mapInArrow(count, "shard long, run binary").repartition("shard").sortWithinPartitions("shard")
    return [r.asDict() for r in materialize(found.mapInArrow(write, "shard long, n long, places long, path string")).collect()]  # one row a file


def marked_segments(rows: DataFrame, repeated: list[dict], folder: str, window: int) -> tuple[list[dict], int]:
    """Files of the segments with repeated windows, and the number of shards they are dealt to."""
    n_shards = max(16, sum(f["places"] for f in repeated) // SHARD_SEGMENTS)

    def gather(batches):
        held: dict[tuple[int, bytes], int] = {}
        size = 0

        def sent():
            by = defaultdict(list)
            for (group, text), m in held.items():
                by[group % n_shards].append((group, text, m))
            return pa.record_batch({"shard": pa.array(list(by), pa.int64()), "run": pa.array([pack_segments(x) for x in by.values()], pa.binary())})

        for batch in batches:
            for _, words, mine in documents(texts_of(batch, "text"), repeated, window):
                for group, text, _, _ in segments(words, mine, window):
                    m = held.get((group, text), 0)
                    held[group, text] = m + 1
                    size += 0 if m else len(text) + 200
                if size >= SEGMENT_BYTES:
                    yield sent()
                    held, size = {}, 0
        if held:
            yield sent()

    def write(batches):
        now, groups = None, {}

        def done():
            bits = {group_hash(t): b for found in groups.values() for t, b in marks_of(found, window).items()}
            keys = np.array(sorted(bits), np.int64)
            path = write_arrays(folder, f"marks-{now:05d}", keys, np.array([bits[k] for k in keys.tolist()], "<u4"))
            return pa.RecordBatch.from_pylist([{"shard": now, "n": len(keys), "path": path}])

        for batch in batches:
            for shard, run in zip(batch.column("shard").to_pylist(), batch.column("run").to_pylist()):
                if shard != now:
                    if now is not None:
                        yield done()
                    now, groups = shard, {}
                for group, text, m in unpack_segments(run):
                    found = groups.setdefault(group, {})
                    found[text] = found.get(text, 0) + m
        if now is not None:
            yield done()

    found = rows.mapInArrow(gather, "shard long, run binary").repartition("shard").sortWithinPartitions("shard")
    return [r.asDict() for r in materialize(found.mapInArrow(write, "shard long, n long, path string")).collect()], n_shards  # one row a file


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256``, and with ``with_text`` the kept
    words joined by one space (``kept_text``) and the removed spans as (first word, words).

    Words are taken unchanged.  Null and empty texts and texts shorter than a window keep what they have.  Repeated
    rows repeat each other: all their windows go.  Null ids are kept as they are; an empty table gives an empty result;
    other columns aren't read.
    """
    if not GRAM <= window < GRAM + 32:
        raise ValueError(f"window must be from {GRAM} to {GRAM + 31} words")
    rows = docs.select(id_col, text_col).toDF("doc_id", "text")
    folder = scratch_path(docs.sparkSession, "repeats")
    repeated = repeated_anchors(rows.select("text"), folder, window)
    files, n_shards = marked_segments(rows.select("text"), repeated, folder, window)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch, "text")
            words_n, removed, sums, kept_texts, spans = [], [], [], [], []
            marks = loaded(Marks, files)
            work = list(documents(texts, repeated, window))
            seg = [(d, s) for d, (_, words, mine) in enumerate(work) for s in segments(words, mine, window)]
            keys = np.array([group_hash(s[1]) for _, s in seg], np.int64)
            groups = np.array([s[0] for _, s in seg], np.int64)
            bits = marks.of(keys, groups % np.int64(n_shards)) if len(seg) else keys
            hit = defaultdict(list)
            for x in np.flatnonzero(bits).tolist():
                d, (_, _, first, n) = seg[x]
                hit[d] += [first + i for i in range(n) if bits[x] >> i & 1]
            for d, (_, words, _) in enumerate(work):
                gone = []
                if d in hit:
                    step = np.zeros(len(words) + 1, np.int64)
                    starts = np.array(hit[d])
                    np.add.at(step, starts, 1)
                    np.add.at(step, starts + window, -1)
                    drop = np.cumsum(step[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], drop, [False]]).astype(np.int8)))
                    gone = [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])]
                    kept = b" ".join([words[i] for i in np.flatnonzero(~drop).tolist()])
                else:
                    kept = b" ".join(words)
                words_n.append(len(words))
                removed.append(sum(n for _, n in gone))
                sums.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode("utf-8", "replace"))
                    spans.append([{"first": a, "n": n} for a, n in gone])
            out = {"doc_id": batch.column("doc_id"), "n_words": pa.array(words_n, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                   "kept_sha256": pa.array(sums, pa.string())}
            if with_text:
                out |= {"kept_text": pa.array(kept_texts, pa.string()),
                        "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())])))}
            yield pa.record_batch(out)

    more = ", kept_text string, spans array<struct<first: long, n: long>>" if with_text else ""
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string{more}")
