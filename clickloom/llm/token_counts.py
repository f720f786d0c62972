"""Token counts by byte-pair merging, with no token ids made.

A text becomes words, a word the pre-tokenizer's pieces, a piece its byte symbols.  The symbols form a linked list
and their adjacent pairs a heap by merge rank: the lowest rank is popped and merged until no pair is left.  A piece
counts its first symbols minus its merges; the symbols' numbers inside the heap are positions in the merge list.

Texts stay where they are read: no shuffle, and each worker remembers the counts of the words it has met.
"""

from __future__ import annotations

import json
import os
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from clickloom.llm.common import coded_words

#: Words and pieces whose counts a worker remembers (each half of this at least; about 120 bytes each), and the longest that it does.
KNOWN = 1_500_000
LONGEST_KNOWN = 64
#: A symbol's number takes so many bits in the key of a pair.
SYMBOL_BITS = 20

_COUNTERS: dict[int, TokenCounter] = {}


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes for
    themselves, the others for the characters from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(0x100 + others.index(b)) for b in range(256)]


class Memory(dict):
    """Counts of the latest keys: two generations, the older forgotten when the younger is half of ``KNOWN``."""

    def __init__(self, count):
        super().__init__()
        self.count, self.old = count, {}

    def __missing__(self, key: str) -> int:
        n = self.old.get(key)
        if n is None:
            n = self.count(key)
        if len(key) <= LONGEST_KNOWN:
            if len(self) >= KNOWN // 2:
                self.old = dict(self)
                self.clear()
            self[key] = n
        return n


class TokenCounter:
    """Counts of one vocabulary file (JSON of the tokenizers library, BPE over bytes whose pre-tokenizer drops white space)."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        spec, whole = json.loads(tokenizer_json), Tokenizer.from_str(tokenizer_json)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("not a plain BPE vocabulary")
        self.normalize = whole.normalizer.normalize_str if whole.normalizer else str
        self.pieces = whole.pre_tokenizer.pre_tokenize_str
        if any("Ġ" in p or any(c.isspace() for c in p) for p, _ in self.pieces(self.normalize(" a  b\n c "))):
            raise ValueError("the pre-tokenizer keeps white space, so words can't be counted one by one")
        added = spec["added_tokens"]
        if any(t["normalized"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added):
            raise ValueError("added tokens must be found in the plain text, anywhere in it")
        # the longest of those that begin at a place is taken, the first place first
        self.special = re.compile("|".join(re.escape(t) for t in sorted((t["content"] for t in added), key=len, reverse=True)) or r"(?!)")
        self.end = model.get("end_of_word_suffix") or ""
        self.number = {s: i for i, s in enumerate(model["vocab"])}
        if any(s + e not in self.number for s in byte_symbols() for e in ("", self.end)):
            raise ValueError("the vocabulary lacks a byte")
        #: pair of symbols -> rank of its merge; the symbol that each merge makes
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for i, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self.number[a] << SYMBOL_BITS | self.number[b]] = i
            self.made.append(self.number[a + b])
        self.end_number = {c: self.number[c + self.end] for c in byte_symbols()}
        self.split = self._splitter(spec["pre_tokenizer"])
        self.words, self.parts = Memory(self.count_word), Memory(self.count_piece)

    def _splitter(self, steps: dict):
        """Pieces of a normalized run.  Where the vocabulary only keeps the matches of a pattern and spells their bytes,
        printable ASCII, which spells itself, needs the pattern alone; all else goes through the library's pre-tokenizer."""
        steps = steps["pretokenizers"] if steps["type"] == "Sequence" else [steps]
        plain = None
        if [x["type"] for x in steps] == ["Split", "ByteLevel"] and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"]):
            if (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True) and "Regex" in steps[0]["pattern"]:
                plain = regex.compile(steps[0]["pattern"]["Regex"]).findall

        def split(text: str) -> list[str]:
            if plain and text.isascii() and text.isprintable():
                return plain(text)
            return [p for p, _ in self.pieces(text)]
        return split

    @classmethod
    def of(cls, tokenizer_json: str) -> TokenCounter:
        """This worker's counter: the words it has met serve its later tasks too."""
        key = hash(tokenizer_json)
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = cls(tokenizer_json)
        return _COUNTERS[key]

    def merged(self, symbols: list[int]) -> int:
        """Symbols left when no adjacent pair merges any more.  ``symbols`` is used up."""
        n = left = len(symbols)
        bits, get, made = n.bit_length(), self.rank.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        #: rank of the pair that begins at a place, -1 for none: a heap entry that differs from it is out of date
        now = [get(a << SYMBOL_BITS | b, -1) for a, b in zip(symbols, symbols[1:])]
        heap = [r << bits | i for i, r in enumerate(now) if r >= 0]
        now.append(-1)
        heapify(heap)
        place = (1 << bits) - 1
        while heap:
            top = heappop(heap)
            i, r = top & place, top >> bits
            if now[i] != r:
                continue
            j = after[i]
            symbols[i] = symbol = made[r]
            now[j] = -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                now[i] = r = get(symbol << SYMBOL_BITS | symbols[k], -1)
                if r >= 0:
                    heappush(heap, r << bits | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                now[h] = r = get(symbols[h] << SYMBOL_BITS | symbol, -1)
                if r >= 0:
                    heappush(heap, r << bits | h)
        return left

    def count_piece(self, piece: str) -> int:
        symbols = list(map(self.number.__getitem__, piece))
        symbols[-1] = self.end_number[piece[-1]]
        return self.merged(symbols)

    def count_word(self, word: str) -> int:
        """Tokens of a run without white space."""
        plain = self.special.split(word)
        count = self.parts.__getitem__
        return len(plain) - 1 + sum(count(piece) for run in plain if run for piece in self.split(self.normalize(run)))

    def count(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row: the UTF-8 bytes of the whole text and its tokens, without
    begin, end or added special tokens; strings of special tokens inside a text are one token each, as the library
    has it by default; ``over_limit``: more than ``limit`` tokens.

    A null text is empty: no bytes, no tokens.  Null ids and repeated rows are rows like any other; an empty table
    gives none.  Other columns aren't read.
    """
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB, whatever the input

    def count(batches):
        counter = TokenCounter.of(shared.value)
        for batch in batches:
            totals = np.zeros(batch.num_rows, np.int64)
            for first, lengths, codes, words in coded_words(batch.column("text")):
                ends = np.cumsum(lengths)
                sums = np.concatenate([[0], np.cumsum(counter.count(words.to_pylist())[codes])])
                totals[first:first + len(lengths)] = sums[ends] - sums[ends - lengths]
            n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": n_bytes, "n_tokens": pa.array(totals),
                                   "over_limit": pa.array(totals > limit)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
