"""Language identification by word-first backoff.

A word that the model knows scores its log frequency in each language.  An
unseen word falls back to the longest character n-grams of it (with word
edges) that the model knows, five characters down to one, and scores the mean
of their log frequencies.  A text's scores are the sums over all its words
plus the log of the language's share of documents; ``score`` is the best
language's softmax.

The model is fitted on at most ``per_lang`` labelled documents of each language
(a seeded hash of the id picks them), whole texts, counted in Spark: that is
the documented bound of the fit and of what is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from clickloom.llm.common import chunks_of_words, texts_of

LONGEST = 5


def letters(word: bytes) -> str:
    w = word.decode("utf-8", "replace")
    return w.lower() if w.isalpha() else "".join(c for c in w if c.isalpha()).lower()


def grams(word: str, n: int) -> list[str]:
    w = f" {word} "
    return [w[i:i + n] for i in range(len(w) - n + 1) if n > 1 or w[i] != " "]


def fit(train: DataFrame, per_lang: int = 500, min_count: int = 2, seed: int = 7) -> dict:
    """``train(doc_id, lang, text)`` -> the model.  Rows without text or lang are not learned from."""
    rows = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    luck = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / float(1 << 53)
    picked = rows.join(F.broadcast(sizes), "lang").filter(luck < F.lit(per_lang) / F.col("n")).select("lang", "text")  # one row a language

    def count(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, lists in chunks_of_words(texts_of(batch, "text"), lower=False):
                found: dict[tuple[str, int, str], int] = {}
                words: dict[tuple[str, str], int] = {}
                for lang, ws in zip(langs[first:], lists):
                    for raw in ws:
                        if w := letters(raw):
                            words[lang, w] = words.get((lang, w), 0) + 1
                for (lang, w), c in words.items():
                    found[lang, 0, w] = c
                    for n in range(1, LONGEST + 1):
                        for g in grams(w, n):
                            found[lang, n, g] = found.get((lang, n, g), 0) + c
                if found:
                    lang, n, gram = zip(*found)
                    yield pa.record_batch({"lang": pa.array(lang), "n": pa.array(n, pa.int32()), "gram": pa.array(gram), "c": pa.array(list(found.values()), pa.int64())})

    counts = picked.mapInArrow(count, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    seen = counts.withColumn("all", F.sum("c").over(W.partitionBy("n", "gram"))).filter(F.col("all") >= min_count)
    total = {r["lang"]: r["n"] for r in sizes.collect()}
    langs = sorted(total)
    place = {x: i for i, x in enumerate(langs)}
    got = seen.select("n", "gram", "lang", "c").toArrow()  # bounded by per_lang
    index: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    rows = np.empty(got.num_rows, np.int64)
    for i, (n, gram) in enumerate(zip(got.column("n").to_pylist(), got.column("gram").to_pylist())):
        rows[i] = index[n].setdefault(gram, sum(map(len, index)) + 1)
    table = np.zeros((sum(map(len, index)) + 1, len(langs)), np.float64)
    table[rows, [place[x] for x in got.column("lang").to_pylist()]] = got.column("c").to_numpy()
    for known in index:
        if known:
            at = np.fromiter(known.values(), np.int64)
            table[at] = np.log((table[at] + 0.5) / (table[at].sum(0) + 0.5 * (len(at) + 1)))
    all_docs = sum(total.values())
    prior = np.array([math.log(total[x] / all_docs) for x in langs])
    return {"langs": langs, "index": index, "table": table.astype(np.float32), "prior": prior}


#: Words whose scores a worker keeps (about 170 bytes each).
KNOWN_WORDS = 800_000


class Words(dict):
    """bytes of a word -> row of ``scores``; row 0 is a word without letters."""

    def __init__(self, model: dict):
        super().__init__()
        self.model = model
        self.scores = np.zeros((KNOWN_WORDS + 2, len(model["langs"])), np.float32)

    def __missing__(self, raw: bytes) -> int:
        w, row = letters(raw), 0
        if w:
            index, table = self.model["index"], self.model["table"]
            row = len(self) + 1
            at = index[0].get(w)
            if at is not None:
                self.scores[row] = table[at]
            else:
                self.scores[row] = 0
                edged, size = f" {w} ", len(w) + 2
                for n in range(LONGEST, 0, -1):
                    get = index[n].get
                    if known := [x for i in range(size - n + 1) if (x := get(edged[i:i + n]))]:
                        self.scores[row] = table.take(known, 0).sum(0) / len(known)
                        break
        self[raw] = row
        return row


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs(doc_id, held_out, text)`` with ``lang_pred`` and ``score``: ``und`` and 0 where the
    text is null or has no letter, or nothing was learned.  Equal scores go to the smaller code."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's per_lang

    def run(batches):
        model = shared.value
        langs = model["langs"]
        words = model.setdefault("words", Words(model))  # this worker's later tasks know them too
        for batch in batches:
            preds: list[str] = []
            scores: list[float] = []
            for _, lists in chunks_of_words(texts_of(batch, "text"), lower=False):
                for ws in lists:
                    total = np.zeros(len(langs), np.float64)
                    known = False
                    for at in range(0, len(ws), 50_000):
                        if len(words) + 50_000 > KNOWN_WORDS:
                            words.clear()
                        rows = np.fromiter(map(words.__getitem__, ws[at:at + 50_000]), np.int64, len(ws[at:at + 50_000]))
                        known = known or bool(rows.any())
                        total += words.scores[rows].sum(0, dtype=np.float64)
                    if not known or not langs:
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    total += model["prior"]
                    best = int(total.argmax())
                    preds.append(langs[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                                   "lang_pred": pa.array(preds, pa.string()), "score": pa.array(scores, pa.float64())})

    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Fit on the rows where ``held_out`` (a boolean column) is false; predict every row of ``docs``.

    One row per row: null ids and repeated rows stay.  Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out.alias("held_out"))
    return predict(rows.select("doc_id", "held_out", "text"), fit(rows.filter(~F.col("held_out")), **options))
