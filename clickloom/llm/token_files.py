"""Token ids as Arrow files of fixed-size lists.

Documents in ascending id order are encoded, ended by an end id, and written
one after another as sequences of equal length: each file is an Arrow IPC file
whose batches hold ``ids`` (fixed_size_list of uint16, or uint32 for
vocabularies over 65,536) and ``mask`` (fixed_size_list of bool, one bit each, false on the
padding that fills a file's last sequence).  No batch is compressed, so a
memory map gives any sequence without a copy (``SequenceFile``).  A second
Arrow file beside it lists the documents: id and number of tokens.

Files are ranges of document ids, made by one range shuffle of the texts.

Words repeat, so each worker keeps the ids of the words it has met: the
pre-tokenizer of the vocabulary must never join characters across white space
(those in ``/opt/tokenizers`` of kind "word" drop it), which makes encoding by
word equal to encoding the whole text.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from clickloom.llm.common import coded_words, materialize
from clickloom.llm.files import create, open_file
from clickloom.session import scratch_path

#: Sequences in a batch.
BATCH = 128
INDEX = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


#: Words whose ids a worker keeps (about 200 bytes each): half of them are of the latest words, half of those before.
KNOWN_WORDS = 1_200_000
_ENCODERS: dict[int, WordEncoder] = {}


class WordEncoder:
    """Words -> their ids.  A worker remembers the ids of words it has met."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        joined = self.tokenizer.pre_tokenizer.pre_tokenize_str("a b\nc") if self.tokenizer.pre_tokenizer else []
        if [p.strip("Ġ▁").removesuffix("</w>") for p, _ in joined] != ["a", "b", "c"] or any(p[0] in "Ġ▁ " for p, _ in joined):
            raise ValueError("the pre-tokenizer keeps or joins white space, so words can't be encoded one by one")
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # where the vocabulary lowers letters, so may Arrow, and fewer words are to be told apart; strings of added tokens
        # are found before that, letter by letter
        lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AZ") == "az"
        self.lower = lowers
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def coded(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
        """``coded_words`` of the texts in a form that gives the same ids: in lower case where that changes none."""
        for first, lengths, codes, words in coded_words(texts, lower=self.lower):
            if self.lower and any(pc.any(pc.match_substring(words, a)).as_py() for a in self.added):
                part = texts.slice(first, len(lengths))
                yield from ((n, c, w.to_pylist()) for _, n, c, w in coded_words(part))
            else:
                yield lengths, codes, words.to_pylist()

    @classmethod
    def of(cls, tokenizer_json: str) -> WordEncoder:
        """This worker's encoder: the words it has met serve its later tasks too."""
        key = hash(tokenizer_json)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = cls(tokenizer_json)
        return _ENCODERS[key]

    def words(self, words: list[str]) -> list[bytes]:
        """Each word's ids, as bytes of ``dtype``."""
        if len(self.known) > KNOWN_WORDS // 2:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = []
        for w in words:
            if w not in known:
                if w in old:
                    known[w] = old[w]
                else:
                    new.append(w)
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            for w, e in zip(part, found, strict=True):
                known[w] = np.array(e.ids, self.dtype).tobytes()
        return list(map(known.__getitem__, words))

    def encode(self, lengths: np.ndarray, codes: np.ndarray, words: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts of ``coded_words``: the ids of all, each text ended by ``end_id``, and how many each has."""
        spelled = [*self.words(words), np.array([end_id], self.dtype).tobytes()]
        size = np.fromiter(map(len, spelled), np.int64, len(spelled)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(spelled), self.dtype)
        ends = np.cumsum(lengths)
        all_codes = np.insert(codes.astype(np.int64), ends, len(words))
        n = size[all_codes]
        past = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(size) - size)[all_codes] - (past - n), n) + np.arange(past[-1] if len(past) else 0)]
        return ids, np.diff(past[ends + np.arange(len(ends))], prepend=0)


class SequenceWriter:
    def __init__(self, folder: str, part: int, dtype: np.dtype, seq_len: int):
        self.path, self.stream = create(folder, f"ids-{part:05d}")
        self.dtype, self.n = dtype, seq_len
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = pa.ipc.new_file(self.stream, self.schema)
        self.held: list[bytes] = []
        self.size = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.tobytes())
        self.size += ids.nbytes
        step = self.n * BATCH * self.dtype.itemsize
        if self.size >= step:
            data = b"".join(self.held)
            for at in range(0, len(data) - step + 1, step):
                self._batch(np.frombuffer(data, self.dtype, self.n * BATCH, at), self.n * BATCH)
            self.held = [data[len(data) // step * step:]]
            self.size = len(self.held[0])

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.n),
                                              pa.FixedSizeListArray.from_arrays(mask, self.n)], schema=self.schema))

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        if len(ids):
            self._batch(np.concatenate([ids, np.zeros(-len(ids) % self.n, self.dtype)]), len(ids))
        self.out.close()
        self.stream.close()


class SequenceFile:
    """Random access to the sequences of one file."""

    def __init__(self, path: str):
        self.file = open_file(path)
        self.reader = pa.ipc.open_file(self.file)

    def sequence(self, i: int) -> tuple[pa.Array, pa.Array]:
        """Sequence i's ids and mask as Arrow arrays: slices of the mapped file, nothing is copied."""
        batch = self.reader.get_batch(i // BATCH)
        at, n = i % BATCH, batch.schema.field("ids").type.list_size
        return batch.column("ids").values.slice(at * n, n), batch.column("mask").values.slice(at * n, n)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence i's ids (a view of the mapped file) and mask (its bits as bytes)."""
        ids, mask = self.sequence(i)
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def runs(self) -> Iterator[np.ndarray]:
        """All real ids in order, a batch at a time."""
        for b in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(b)
            ids = batch.column("ids").values.to_numpy(zero_copy_only=True)
            yield ids[:batch.column("mask").values.true_count]


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def write_sequences(docs: DataFrame, folder: str, tokenizer_path: str | None = None, seq_len: int = 2048, end_id: int = 1,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; one row a file: ``part, path, index_path, n_tokens, start``
    (``start``: tokens in the files before it).

    A null text is empty and gives the end id alone.  A null id comes first; rows with equal ids come in the order
    of their texts' first 256 characters, then of their places in the input, so that files split the longest run of one
    id.  An empty table writes no file.  Other columns aren't read.
    """
    spark = docs.sparkSession
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB, whatever the input
    order = ["doc_id", "tie", "place"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.substring("text", 1, 256)).withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches):
        encoder = writer = None
        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                part = TaskContext.get().partitionId()
                encoder = WordEncoder.of(shared.value)
                writer = SequenceWriter(folder, part, encoder.dtype, seq_len)
                index_path, stream = create(folder, f"docs-{part:05d}")
                index = pa.ipc.new_file(stream, INDEX)
            counts = []
            for lengths, codes, words in encoder.coded(batch.column("text")):
                ids, n = encoder.encode(lengths, codes, words, end_id)
                writer.add(ids)
                counts.append(n)
                total += len(ids)
            index.write_batch(pa.record_batch([batch.column("doc_id"), pa.array(np.concatenate(counts), pa.int64())], schema=INDEX))
        if writer is not None:
            writer.close()
            index.close()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": writer.path, "index_path": index_path, "n_tokens": total}])

    files = materialize(rows.mapInArrow(write, "part long, path string, index_path string, n_tokens long"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(files: DataFrame) -> DataFrame:
    """One row per document, from the files alone: ``doc_id, start, n_tokens, ids_crc32, path``."""

    def read(batches):
        for batch in batches:
            for f in batch.to_pylist():
                yield from _documents(f)

    # by number, so that files stay apart: every id passes the task that reads its file
    return files.repartition(max(1, files.count()), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string")


def _documents(f: dict) -> Iterator[pa.RecordBatch]:
    runs, held, at = SequenceFile(f["path"]).runs(), np.empty(0, "<u4"), 0
    start = f["start"]
    index = pa.ipc.open_file(open_file(f["index_path"]))
    for b in range(index.num_record_batches):
        batch = index.get_batch(b)
        counts = batch.column("n_tokens").to_pylist()
        starts, sums = [], []
        for n in counts:
            crc, left = 0, n
            while left:
                if at == len(held):
                    held, at = next(runs).astype("<u4"), 0
                piece = held[at:at + left]
                crc = zlib.crc32(piece, crc)
                at, left = at + len(piece), left - len(piece)
            starts.append(start)
            sums.append(crc)
            start += n
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "start": pa.array(starts, pa.int64()), "n_tokens": batch.column("n_tokens"),
                               "ids_crc32": pa.array(sums, pa.int64()), "path": pa.array([f["path"]] * len(counts))})


def token_documents(docs: DataFrame, **options) -> DataFrame:
    """Write the files under the shared folder and read every document back from them."""
    return read_documents(write_sequences(docs, scratch_path(docs.sparkSession, "tokens"), **options))
