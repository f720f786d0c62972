"""Benchmark decontamination by SimHash of item-sized windows.

Every window of a document as long as a benchmark item gets a 64-bit SimHash
of its word pairs (sign of the sum of +-1 vectors, from one running sum).  Item
lengths fall into classes: the items of a class are at least w + s - 1 words
long, for the class's window w and stride s, so each item puts in the
fingerprints of all its w-word sub-windows and a document needs only every
s-th window: a passage at any place meets one of them exactly aligned.  Windows
are counted from each document's first word, and one more ends with its last.

A document may be shorter than the window and yet hold enough of an item: items
also put their sub-windows into the classes of such lengths, down to the
shortest that can reach the threshold, and documents as long as those classes'
items are looked up there.

Fingerprints are cut into four 16-bit blocks.  Two fingerprints at most
``RADIUS`` bits apart agree in some block up to RADIUS // 4 bits, so each item
enters all such neighbours of its blocks in a table, and a window that finds
none of its four block values there is out: every pair within the radius is
found.  A candidate is confirmed by the weighted similarity of 5-word shingles
(sum of the smaller over the sum of the larger multiplicities) of the item and
the item-sized window, at the five places around its alignment; before that,
candidates go that share no shingle although the threshold takes more of them
than have room outside the window.

The benchmark travels to the tasks in slices of at most ``SLICE_BYTES`` of
text, one pass over the documents a slice, so what is broadcast is bounded.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickloom.llm.common import WordHash, coded_words, mix64, rolling

SHINGLE = 5
#: Bits.  Copies differ by 0, edits of single words by 6 to 8, one stretch replaced down to similarity 0.75 by 15 or,
#: rarely, more (recall: README).
RADIUS = 15
#: A fingerprint takes 11 kB of tables (697 neighbours of each block), an item about ten fingerprints.
SLICE_BYTES = 1 << 20
#: Bits of the shingles' hashes in the table that tells whether any item has them.
SOME_BITS = 22
#: Words in one run of prefix sums: 16,384 x 64 x 2 bytes.
RUN = 16_384


def stride_of(n_words: int) -> int:
    return max(1, n_words // 8)


def class_of(n_words: int) -> tuple[int, int]:
    """Window and stride of the class an item of so many words is in: classes begin about an eighth apart."""
    least = 1
    while (after := least + max(1, least // 8)) <= n_words:
        least = after
    return least - stride_of(least) + 1, stride_of(least)


def shortest(n_words: int, threshold: float) -> int:
    """Words of the shortest text that can be ``threshold`` similar to an item of so many words: all its shingles are the item's."""
    return n_words if n_words < SHINGLE else max(SHINGLE, SHINGLE - 1 + math.ceil(threshold * (n_words - SHINGLE + 1) - 1e-9))


def places(n: np.ndarray, who: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the texts ``who`` (of ``n`` words, one after another), every ``stride`` words from a text's first and one
    flush with its end: (first words, texts)."""
    last = n[who] - window
    count = -(-last // stride) + 1
    text = np.repeat(who, count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return (np.cumsum(n) - n)[text] + np.minimum(nth * stride, np.repeat(last, count)), text


def pair_bits(hashes: np.ndarray) -> np.ndarray:
    """+1 / -1 vectors (int16, 64 wide) of the word pairs that begin at each word but the last."""
    x = rolling(hashes, 2)
    return np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16) * np.int16(2) - np.int16(1)


def fingerprints(running: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """SimHash (uint64) of the windows at ``first``.  running: sums of the pairs before each word."""
    return np.packbits(running[first + window - 1] > running[first], axis=1).view(np.uint64).ravel()


def prints_of(hashes: np.ndarray, window: int, stride: int = 1) -> np.ndarray:
    """SimHash of all windows of ``window`` words, ``stride`` apart; one word stands for itself."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if window == 1:
        return mix64(hashes.view(np.uint64)[::stride])
    bits = pair_bits(hashes)
    running = np.zeros((len(bits) + 1, 64), np.int16)
    np.cumsum(bits, axis=0, dtype=np.int16, out=running[1:])  # windows are far shorter than 32,768 words: differences stay right
    return fingerprints(running, np.arange(0, n, stride), window)


def weighted_similarity(a: list, b: list) -> float:
    """Sum of the smaller over sum of the larger multiplicities of the 5-word shingles (or whole sequences)."""
    x, y = ([tuple(w[i:i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))] if w else [] for w in (a, b))
    x, y = Counter(x), Counter(y)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


class Index:
    """The fingerprints of a slice of the benchmark."""

    def __init__(self, items: list[tuple[int, bytes]], radius: int = RADIUS, threshold: float = 0.75):
        self.radius, self.threshold = radius, threshold
        word = WordHash()
        self.words = {i: t.lower().split() for i, t in items}
        prints: dict[tuple[int, int], list] = defaultdict(list)
        short: dict[tuple[int, int], list] = defaultdict(list)
        for i, w in self.words.items():
            if not w:
                continue
            hashes, own = word.of([w])[0], class_of(len(w))
            for offset, f in enumerate(prints_of(hashes, own[0]).tolist()):
                prints[own].append((f, i, offset))
            for window, stride in sorted({class_of(n) for n in range(shortest(len(w), threshold), len(w))} - {own}):
                for offset, f in enumerate(prints_of(hashes, window).tolist()):
                    short[window, stride].append((f, i, offset))
        self.shingles = self._shingles(word)
        #: which low bits the items' shingles have
        self.some = np.zeros(1 << SOME_BITS, bool)
        for w in self.words.values():
            self.some[rolling(word.of([w])[0], SHINGLE) & np.uint64((1 << SOME_BITS) - 1)] = True
        flips = [sum(1 << b for b in bits) for n in range(radius // 4 + 1) for bits in combinations(range(16), n)]
        self.flips = np.array(flips, np.uint16)
        self.classes = [self._class(c, found, self.flips) for c, found in sorted(prints.items())]
        # few windows look these up, and they're many: the windows' blocks are varied, not theirs
        self.short = [self._class(c, found, self.flips[:1]) for c, found in sorted(short.items())]

    def _shingles(self, word: WordHash) -> np.ndarray:
        """Sorted hashes of (item, shingle)."""
        own = [rolling(word.of([w])[0], SHINGLE) ^ mix64(np.array([i], np.uint64)) for i, w in self.words.items()]
        return np.unique(np.concatenate([np.empty(0, np.uint64), *own]))

    def needless(self, window: int, items: np.ndarray) -> np.ndarray:
        """Whether a window may hold these items without a shingle in common.  A text as long as the item, at most two words
        off its alignment, has up to length - window + 2 shingles that aren't the window's."""
        length = np.array([len(self.words[i]) for i in items.tolist()], np.int64)
        t = self.threshold
        return (2 * t / (1 + t) * (length - SHINGLE + 1) <= length - window + 2) | (window < SHINGLE)

    def sharing(self, shingles: np.ndarray, first: np.ndarray, window: int, items: np.ndarray) -> np.ndarray:
        """Whether the windows at ``first`` share a shingle with their items, or needn't."""
        out = self.needless(window, items)
        ask = np.flatnonzero(~out)
        for k in range(0, len(ask), 1 << 14):
            who = ask[k:k + (1 << 14)]
            key = shingles[first[who, None] + np.arange(window - SHINGLE + 1)] ^ mix64(items[who].astype(np.uint64))[:, None]
            at = np.minimum(np.searchsorted(self.shingles, key), len(self.shingles) - 1)
            out[who] = (self.shingles[at] == key).any(axis=1)
        return out

    @staticmethod
    def _class(of: tuple[int, int], found: list, flips: np.ndarray) -> tuple:
        f = np.array([x[0] for x in found], np.uint64)
        tables = []
        for block in range(4):
            value = (f >> np.uint64(16 * block)).astype(np.uint16)
            near = (value[:, None] ^ flips[None, :]).ravel()
            starts = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=1 << 16))]).astype(np.int32)
            tables.append((starts, (np.argsort(near, kind="stable") // len(flips)).astype(np.int32)))
        return *of, f, np.array([x[1:] for x in found], np.int64), tables

    def candidates(self, prints: np.ndarray, f: np.ndarray, tables: list, vary: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, fingerprint) at most ``radius`` bits apart; ``vary``: the tables hold the blocks as they are."""
        left, right = [], []
        for block, (starts, who) in enumerate(tables):
            value = (prints >> np.uint64(16 * block)).astype(np.uint16)
            if vary:
                value = (value[:, None] ^ self.flips[None, :]).ravel()
            n = starts[1:][value] - starts[value]
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            n = n[hit]
            at = np.repeat(starts[value[hit]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            w, i = np.repeat(hit // len(self.flips) if vary else hit, n), who[at]
            close = np.bitwise_count(prints[w] ^ f[i]) <= self.radius
            left.append(w[close])
            right.append(i[close])
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        return both[0], both[1]

    def hits(self, word: WordHash, lists: list[list[bytes]], threshold: float) -> list[tuple[int, int, float, int]]:
        """(list, item, similarity, first word) of each list and item that reach the threshold; the best place."""
        hashes, n = word.of(lists)
        return self.hits_in(hashes, n, lambda d, lo, hi: lists[d][lo:hi], threshold)

    def hits_in(self, hashes: np.ndarray, n: np.ndarray, words: Callable[[int, int, int], list], threshold: float) -> list[tuple[int, int, float, int]]:
        """The same of texts by their words' hashes and numbers; ``words`` gives a text's words from one place to another.

        Windows without any shingle of the slice's items are out before their fingerprints are made, unless their class
        has items that ``needless`` says may be found without: what remains is what ``sharing`` would let pass."""
        begins, shingles = np.cumsum(n) - n, rolling(hashes, SHINGLE)
        seen = np.concatenate([[0], np.cumsum(self.some[shingles & np.uint64((1 << SOME_BITS) - 1)])])
        probes = []
        for kind, vary in ((self.classes, False), (self.short, True)):
            for window, stride, f, origin, tables in kind:
                least = window + stride - 1
                who = np.flatnonzero((n >= least) & (n < least + max(1, least // 8)) if vary else n >= window)
                place, text = places(n, who, window, stride)
                if len(place) and not vary and not self.needless(window, np.unique(origin[:, 0])).any():
                    keep = seen[place + window - SHINGLE + 1] > seen[place]
                    place, text = place[keep], text[keep]
                if len(place):
                    cuts = np.searchsorted(place, np.arange(0, len(hashes) + RUN, RUN))
                    probes.append((window, f, origin, tables, vary, place, text, cuts))
        widest = max((p[0] for p in probes), default=0)
        tried: dict[tuple[int, int], set[int]] = defaultdict(set)
        for run, at in enumerate(range(0, len(hashes) if probes else 0, RUN)):
            here = [p for p in probes if p[-1][run] < p[-1][run + 1]]
            if not here:
                continue
            part = hashes[at:at + RUN + widest - 1]
            bits = pair_bits(part) if len(part) > 1 else np.empty((0, 64), np.int16)
            running = np.zeros((len(bits) + 1, 64), np.int16)
            np.cumsum(bits, axis=0, dtype=np.int16, out=running[1:])
            for window, f, origin, tables, vary, place, text, cuts in here:
                a, b = cuts[run], cuts[run + 1]
                first = place[a:b] - at
                if window == 1:
                    prints = mix64(part[first].view(np.uint64))
                else:
                    prints = fingerprints(running, first, window)
                w, i = self.candidates(prints, f, tables, vary)
                item, offset = origin[i].T
                if not vary:
                    ok = self.sharing(shingles, place[a + w], window, item)
                    w, item, offset = w[ok], item[ok], offset[ok]
                lot = text[a + w]
                for d, p, x in zip(lot.tolist(), (place[a + w] - begins[lot] - offset).tolist(), item.tolist()):
                    tried[d, x].add(p)
        out = []
        for (d, item), at in tried.items():
            want, size = self.words[item], int(n[d])
            best, first = 0.0, 0
            for p in sorted({min(max(q + shift, 0), max(0, size - len(want))) for q in at for shift in (-2, -1, 0, 1, 2)}):
                s = weighted_similarity(want, words(d, p, p + len(want)))
                if s > best:
                    best, first = s, p
            if best >= threshold:
                out.append((d, item, best, first))
        return out


def _slices(benchmark: DataFrame, item_col: str, item_text_col: str):
    """The benchmark's distinct (id, text) items as broadcasts of at most about ``SLICE_BYTES`` of text each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).filter(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // SLICE_BYTES))
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()  # one slice
        yield spark.sparkContext.broadcast([(r["item_id"], r["text"].encode()) for r in part])


def _hits(batches, items: list[tuple[int, bytes]], threshold: float, radius: int):
    """Each batch with its hits: (row, item id, similarity, first word), the best place of each row and item."""
    names = [i for i, _ in items]
    index, word = Index([(x, t) for x, (_, t) in enumerate(items)], radius, threshold), WordHash.shared()
    for batch in batches:
        best: dict[tuple[int, int | None], tuple[float, int]] = {}
        for first, n, codes, coded in coded_words(batch.column("text"), lower=True, most=1 << 21):
            spelled = coded.cast(pa.large_binary()).to_pylist()
            hashes = np.fromiter(map(word.__getitem__, spelled), np.int64, len(spelled))[codes]
            begins = np.cumsum(n) - n

            def words(d: int, lo: int, hi: int, spelled=spelled, codes=codes, begins=begins, n=n) -> list[bytes]:
                return [spelled[c] for c in codes[begins[d] + lo:begins[d] + min(hi, n[d])].tolist()]

            for d, item, s, p in index.hits_in(hashes, n, words, threshold):
                if s > best.get((first + d, names[item]), (0.0,))[0]:
                    best[first + d, names[item]] = (s, p)
        yield batch, [(d, i, s, p) for (d, i), (s, p) in best.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, radius: int = RADIUS, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, similarity, first_word``: each row of ``docs`` with each benchmark item that one of its
    item-sized windows (the whole document, if shorter) holds at ``threshold`` or more; the best such window.

    Words are lower-cased in A-Z.  Null and empty texts and items take no part.  Items under five words compare as one
    whole sequence.  Null ids and repeated rows of documents give rows of their own; items are told apart by id, of equal
    ids the texts are all used.  Empty tables give empty results.  Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for shared in _slices(benchmark, item_col, item_text_col):

        def run(batches, shared=shared):
            for batch, found in _hits(batches, shared.value, threshold, radius):
                rows, items, s, p = zip(*found) if found else ((), (), (), ())
                yield pa.record_batch({"doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())), "item_id": pa.array(items, pa.int64()),
                                       "similarity": pa.array(s, pa.float64()), "first_word": pa.array(p, pa.int64())})

        got = rows.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long")
        out = got if out is None else out.unionByName(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, radius: int = RADIUS, text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark item (as ``contaminated`` finds them), unchanged."""
    for shared in _slices(benchmark, item_col, item_text_col):
        whole = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))

        def run(batches, shared=shared):
            for batch, found in _hits(batches, shared.value, threshold, radius):
                free = np.ones(batch.num_rows, bool)
                free[[d for d, *_ in found]] = False
                yield pa.record_batch({"row": batch.column("row").filter(pa.array(free))})

        docs = whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}").select("row.*")
    return docs
