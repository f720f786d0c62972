"""Quality by Bradley-Terry pairwise ranking.

Each document has a worth w.x of its text features; P(a is better than b) =
sigmoid(w.(x_a - x_b)).  Preference pairs are (good, bad) documents of the
labelled rows; w minimises the logistic loss on feature differences with an L2
penalty.  The threshold is the quantile of the training worths at the share of
bad documents, and ``score`` = sigmoid(w.x - threshold), so 0.5 is the threshold.

The fit uses at most ``max_labels`` labelled rows (a seeded hash of the id
picks them) and ``max_pairs`` pairs; scoring covers every whole text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clickloom.llm.common import texts_of

PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
N_FEATURES = len(PUNCTUATION) + 16


def features(text: bytes) -> np.ndarray:
    """Fixed-length description of a whole text; all zeros but the constant for an empty one."""
    out = np.zeros(N_FEATURES, np.float32)
    out[-1] = 1.0
    n = len(text)
    words = text.split()
    if not words:
        return out
    at = np.zeros(256, np.int64)
    for i in range(0, n, 1 << 24):
        at += np.bincount(np.frombuffer(text, np.uint8, min(1 << 24, n - i), i), minlength=256)
    k = len(PUNCTUATION)
    out[:k] = np.sqrt(at[PUNCTUATION] / n)
    lines = [x for x in text.split(b"\n") if x]
    distinct = set(words)
    upper, lower = at[65:91].sum(), at[97:123].sum()
    out[k:k + 15] = (
        math.sqrt(upper / n), math.sqrt(lower / n), math.sqrt(at[48:58].sum() / n), math.sqrt(at[10] / n),
        math.sqrt(at[[9, 11, 12, 13, 32]].sum() / n), math.sqrt(at[128:].sum() / n), math.sqrt(at[:9].sum() / n),
        upper / max(1, upper + lower), math.log1p(len(words)) / 10, math.log(n / len(words)), len(distinct) / len(words),
        len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))) / 10, len({w.lower() for w in distinct}) / len(distinct),
        math.sqrt(sum(map(len, distinct)) / len(distinct)) / 3)
    return out


def with_features(docs: DataFrame, keep: list[str], schema: str) -> DataFrame:
    """``keep`` columns plus ``x``: the features as packed float32."""

    def run(batches):
        for batch in batches:
            x = [features(t).tobytes() for t in texts_of(batch, "text")]
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(x, pa.binary())], names=[*keep, "x"])

    return docs.mapInArrow(run, f"{schema}, x binary")


def fit_pairs(x: np.ndarray, good: np.ndarray, max_pairs: int = 60_000, l2: float = 1e-3, steps: int = 25, seed: int = 3) -> dict:
    """Weights, scale of the features, and threshold.  Without both labels every document scores the same:
    1 unless only bad labels are known."""
    if not len(x) or good.all() or not good.any():
        return {"mean": np.zeros(N_FEATURES), "sd": np.ones(N_FEATURES), "w": np.zeros(N_FEATURES),
                "threshold": 20.0 if len(x) and not good.any() else -20.0}
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 1e-6, sd, 1.0)
    z = (x - mean) / sd
    g, b = np.flatnonzero(good), np.flatnonzero(~good)
    luck = np.random.default_rng(seed)
    n = min(max_pairs, len(g) * len(b))
    # every document appears about equally often on its side
    left = np.concatenate([luck.permutation(g) for _ in range(n // len(g) + 1)])[:n]
    right = np.concatenate([luck.permutation(b) for _ in range(n // len(b) + 1)])[:n]
    d = z[left] - z[right]
    w = np.zeros(N_FEATURES)
    for _ in range(steps):  # Newton steps on the mean logistic loss
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(d * p[:, None]).mean(0) + l2 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / n + l2 * np.eye(N_FEATURES)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    worth = z @ w
    return {"mean": mean, "sd": sd, "w": w, "threshold": float(np.quantile(worth, b.size / len(x)))}


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, seed: int = 5) -> dict:
    """``docs(doc_id, text)``, ``labels(doc_id, quality)``: learn from labelled documents.  Null ids and labels teach
    nothing; a document labelled more than once counts as good if at least half of its labels are 1.  Of rows that repeat a
    labelled id the smallest text teaches."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id")
             .agg((F.avg("quality") >= 0.5).alias("good")))
    n = known.count()
    luck = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / float(1 << 53)
    picked = known.filter(luck < min(1.0, 0.98 * max_labels / max(1, n)))
    rows = docs.join(F.broadcast(picked), "doc_id")  # at most about max_labels rows of 9 bytes
    rows = rows.groupBy("doc_id").agg(F.first("good").alias("good"), F.min("text").alias("text"))
    got = with_features(rows.select("good", "text"), ["good"], "good boolean").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    good = got.column("good").to_numpy(zero_copy_only=False).astype(bool) if len(x) else np.empty(0, bool)
    return fit_pairs(x, good)


def score(docs: DataFrame, model: dict, keep: list[str], schema: str) -> DataFrame:
    """``keep`` columns of ``docs`` (which has ``text``) with ``score`` and ``predicted``; a null text is an empty one."""

    def run(batches):
        w = model["w"] / model["sd"]
        shift = float(model["mean"] @ w) + model["threshold"]
        for batch in batches:
            texts = texts_of(batch, "text")
            x = np.stack([features(t) for t in texts]) if texts else np.empty((0, N_FEATURES), np.float32)
            s = 1 / (1 + np.exp(-np.clip(x.astype(np.float64) @ w - shift, -30, 30)))
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                  names=[*keep, "score", "predicted"])

    return docs.mapInArrow(run, f"{schema}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``; learns only from documents that
    ``held_out`` (a column over the id) leaves in.  Null ids are scored and not learned from, repeated rows are
    scored alike, other columns aren't read, an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("quality")).filter(~held_out)
    model = fit(rows, marks, **options)
    return score(rows.withColumn("held_out", held_out), model, ["doc_id", "held_out"], "doc_id long, held_out boolean")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted bad, unchanged; learned from all labelled documents among them."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(ids, labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("quality")), **options)
    whole = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return score(whole, model, ["row"], f"row {whole.schema['row'].dataType.simpleString()}").filter("predicted = 1").select("row.*")
