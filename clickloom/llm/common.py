"""Helpers shared by the training-data operators.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8
text; ``bytes.split()`` splits on exactly that set and ``bytes.lower()``
changes exactly A-Z, so texts travel to Python as bytes.  A null text has no
words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from clickloom.session import checkpoint_root, scratch_path

#: Words held by a worker's word cache before it starts afresh (about 150 bytes each).
CACHE_WORDS = 300_000
#: Words handled together in one numpy pass.
CHUNK_WORDS = 1_000_000
#: Bytes of text split together by Arrow.
CHUNK_BYTES = 1 << 22
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the cluster's shared folder.
    Spark removes it once the frame is unreachable, where its cleaner is told to."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def chunks_of_words(texts: list[bytes], lower: bool, most: int = CHUNK_WORDS) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Consecutive texts as word lists, about ``most`` words at a time: (index of the first text, lists)."""
    first, held, lists = 0, 0, []
    for i, t in enumerate(texts):
        w = (t.lower() if lower else t).split()
        lists.append(w)
        held += len(w)
        if held >= most:
            yield first, lists
            first, held, lists = i + 1, 0, []
    if lists:
        yield first, lists


def coded_words(texts: pa.Array, lower: bool = False, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """Consecutive texts, about ``most`` bytes at a time, without a Python object per word: (index of the first text,
    words of each text, each word's code, the distinct words that the codes stand for)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    places = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        past = places[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(places, past + most, side="right")))
        part = texts.slice(first, end - first)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(part) if lower else part)
        words, parents = lists.flatten(), pc.list_parent_indices(lists)
        real = pc.greater(pc.binary_length(words), 0)  # a text that begins or ends with white space has empty pieces
        coded = words.filter(real).dictionary_encode()
        lengths = np.bincount(parents.filter(real).to_numpy(zero_copy_only=False), minlength=len(part))
        yield first, lengths, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        first = end


_HASHES: WordHash | None = None


class WordHash(dict):
    """word (bytes) -> signed 64-bit hash; starts afresh at ``CACHE_WORDS`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        h = h - (1 << 64) if h >> 63 else h
        self[word] = h
        return h

    @classmethod
    def shared(cls) -> WordHash:
        """This worker's hashes: the words of earlier tasks are known."""
        global _HASHES
        if _HASHES is None:
            _HASHES = cls()
        return _HASHES

    def of(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, one after another, and each list's length."""
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        get = self.__getitem__
        out = np.empty(int(n.sum()), np.int64)
        at = 0
        for w in lists:
            out[at:at + len(w)] = list(map(get, w)) if len(w) < 64 else np.fromiter(map(get, w), np.int64, len(w))
            at += len(w)
        return out, n


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply) on uint64 arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of each k consecutive word hashes: h[i] covers words i..i+k-1 (uint64)."""
    x = hashes.view(np.uint64)
    n = len(x) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(seed * 0x9E3779B97F4A7C15 & MASK64), np.uint64)
    p = np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        out *= p
        out += x[j:j + n]
    return mix64(out)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet under the shared folder and read it back: the frame and its path, which
    the caller deletes (``session.delete_path``) once nothing reads it; else it goes with the driver."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def attach(docs: DataFrame, keys: dict[str, Column], decided: DataFrame, values: list[str]) -> DataFrame:
    """``docs`` with the columns ``values`` of ``decided``, which has a row for every row of ``docs``
    and the columns named in ``keys`` (given there as expressions over ``docs``; nulls are equal).
    Rows with equal keys are interchangeable: they're numbered on both sides and meet by number."""
    names = list(keys)
    left = docs.select(F.struct("*").alias("row"), *[keys[k].alias(f"__{k}") for k in names])
    left = left.withColumn("__rn", F.row_number().over(W.partitionBy(*[f"__{k}" for k in names]).orderBy(F.xxhash64("row"))))
    right = decided.withColumn("__n", F.row_number().over(W.partitionBy(*names).orderBy(*values)))
    right = right.select(*[F.col(k).alias(f"__r_{k}") for k in names], "__n", F.struct(*values).alias("__v"))
    on = F.col("__rn") == F.col("__n")
    for k in names:
        on = on & F.col(f"__{k}").eqNullSafe(F.col(f"__r_{k}"))
    return left.join(right, on).select("row.*", "__v")
