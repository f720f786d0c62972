"""Hard negatives by angular triangle filtering.

Vectors become integers.  Every row keeps its norm and its angles to a few reference directions.  By the triangle
inequality on the sphere the angle between an anchor and a row lies between |a - b| and min(a + b, 2 pi - a - b) for
their angles a, b to any direction; the cosines of these limits, times both norms and widened by more than all rounding,
bound their integer score.  Rows lie in blocks of one label and like angles, so whole blocks are bounded first, then
rows by the direction that is tightest for the anchor.  Only pairs whose bounds reach into what is still open (for
positives, scores from the anchor's current k-th on; for negatives, a positive's window above its current k-th) get
an integer score, and that score alone decides.

Anchors are a stated share of all rows, so the work is a grid of cells, groups of blocks against groups of anchors,
each one task with bounded memory, and every cell gives a bounded number of rows an anchor.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clickloom.llm.common import stored
from clickloom.llm.topk import exact, matrix

#: Reference directions: the rows of least id hash.  They only shape the bounds.
DIRECTIONS = 24
BLOCK = 256
#: Rows in a group of blocks, and anchors in a group of anchors: what one task holds.
GROUP = 16_384
ANCHORS = 4_096
#: Anchors that go through the blocks together.
PACK = 256
#: Radians that stored angles (float32) may be off, and more.
SLACK = 1e-5
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


def integers(m: np.ndarray) -> np.ndarray:
    """The same in the smallest type."""
    most = int(max(m.max(initial=0), -m.min(initial=0)))
    return m.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def angles_to(m: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of rows to unit directions; a zero row is at right angles to all."""
    dots = m.astype(np.float64) @ directions.T
    return np.arccos(np.clip(np.divide(dots, norms[:, None], out=np.zeros_like(dots), where=norms[:, None] > 0), -1, 1)).astype(np.float32)


def limits(near: np.ndarray, far: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score bounds from the limits of an angle and of the product of norms."""
    high, low = np.cos(np.maximum(near - SLACK, 0)), np.cos(np.minimum(far + SLACK, np.pi))
    room = 1 + 1e-9 * most
    return np.where(high > 0, high * most, high * least) + room, np.where(low > 0, low * least, low * most) - room


class Block:
    """Rows of a block and what bounds them."""

    def __init__(self, row: dict, wide: int):
        n = row["n"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.m = np.frombuffer(row["v"], row["kind"]).reshape(n, wide)
        self.norms = np.frombuffer(row["norms"], np.float64)
        self.angles = np.frombuffer(row["angles"], np.float32).reshape(n, -1)
        self.size = int(np.abs(self.m.astype(np.int64)).max(initial=0))

    def bounds(self, angles: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score bounds of anchors against any row."""
        if not self.angles.shape[1]:
            return limits(np.zeros(len(norms)), np.full(len(norms), np.pi), norms * self.norms.min(), norms * self.norms.max())
        lo, hi = self.angles.min(0), self.angles.max(0)
        near = np.maximum(np.maximum(lo - angles, angles - hi), 0).max(1)
        far = np.minimum(angles + hi, 2 * np.pi - angles - lo).min(1)
        return limits(near, far, norms * self.norms.min(), norms * self.norms.max())

    def row_bounds(self, angles: np.ndarray, norms: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score bounds of anchors against each row, by each anchor's ``best`` direction."""
        product = norms[:, None] * self.norms
        if not self.angles.shape[1]:
            return limits(np.zeros(product.shape), np.full(product.shape, np.pi), product, product)
        a, b = angles[np.arange(len(angles)), best][:, None], self.angles[:, best].T
        return limits(np.abs(a - b), np.minimum(a + b, 2 * np.pi - a - b), product, product)


class Asked:
    """Anchors of a cell, and for each the score windows that are open: ``low`` and ``high`` (anchors x windows), in
    which the ``k`` best are gathered."""

    def __init__(self, t: pa.Table, wide: int, k: int, windows: list[list[tuple[int, int]]]):
        self.ids = t.column("vec_id").to_numpy()
        self.labels = t.column("label").to_numpy()
        self.m = matrix(t.column("v"), t.num_rows, wide)
        self.norms = t.column("norm").to_numpy()
        angles = t.column("angles").to_pylist()
        self.angles = np.frombuffer(b"".join(angles), np.float32).reshape(t.num_rows, len(angles[0]) // 4)
        # a direction bounds best where the sine of the anchor's angle to it is smallest
        self.best = np.sin(self.angles).argmin(1) if self.angles.shape[1] else np.zeros(t.num_rows, np.int64)
        most = max((len(w) for w in windows), default=0)
        self.low = np.full((t.num_rows, most), LAST)
        self.high = np.full((t.num_rows, most), NONE)
        for i, w in enumerate(windows):
            for j, (lo, hi) in enumerate(w):
                self.low[i, j], self.high[i, j] = lo, hi
        self.scores = np.full((t.num_rows, most, k), NONE)
        self.names = np.full((t.num_rows, most, k), LAST)
        self.size = int(np.abs(self.m).max(initial=0))

    def open_low(self, who) -> np.ndarray:
        """What a score must reach to matter in each window."""
        return np.maximum(self.low[who], self.scores[who, :, -1])

    def gather(self, who: np.ndarray, got: np.ndarray, ok: np.ndarray, ids: np.ndarray) -> None:
        """Take in the integer scores ``got`` of the anchors ``who`` with rows ``ids``, where ``ok``."""
        for j in range(self.low.shape[1]):
            inside = ok & (got >= np.maximum(self.low[who, j], self.scores[who, j, -1])[:, None]) & (got <= self.high[who, j][:, None])
            some = np.flatnonzero(inside.any(1))
            if len(some):
                rows = who[some]
                s = np.concatenate([self.scores[rows, j], np.where(inside[some], got[some], NONE)], 1)
                n = np.concatenate([self.names[rows, j], np.where(inside[some], ids, LAST)], 1)
                pick = np.lexsort((n, -np.maximum(s, NONE + 1)), axis=1)[:, :self.scores.shape[2]]
                self.scores[rows, j], self.names[rows, j] = np.take_along_axis(s, pick, 1), np.take_along_axis(n, pick, 1)


def search_cell(blocks: list[Block], asked: Asked, same_label: bool) -> tuple[int, int]:
    """Gather each anchor's best rows of its own label, or of others: (pairs scored, pairs of right labels)."""
    scored = pairs = 0
    kind = exact(np.array([[asked.size] * asked.m.shape[1]]), np.array([max((b.size for b in blocks), default=0)])) if asked.m.shape[1] else np.int64
    forward = [b.m.astype(kind).T for b in blocks]
    for at in range(0, len(asked.ids), PACK):
        pack = np.arange(at, min(at + PACK, len(asked.ids)))
        reach = [b.bounds(asked.angles[pack], asked.norms[pack]) for b in blocks]
        q = asked.m[pack].astype(kind)
        for x in np.argsort([-high.max() for high, _ in reach], kind="stable"):
            b, (high, low) = blocks[x], reach[x]
            fits = (b.labels == asked.labels[pack][:, None]) == same_label
            fits &= b.ids != asked.ids[pack][:, None]
            pairs += int(fits.sum())
            near = ((high[:, None] >= asked.open_low(pack)) & (low[:, None] <= asked.high[pack])).any(1) & fits.any(1)
            who = np.flatnonzero(near)
            if not len(who):
                continue
            rows = pack[who]
            up, down = b.row_bounds(asked.angles[rows], asked.norms[rows], asked.best[rows])
            # the windows of an anchor together: from the least open score to the highest end
            ok = fits[who] & (up >= asked.open_low(rows).min(1)[:, None]) & (down <= asked.high[rows].max(1)[:, None])
            cols = np.flatnonzero(ok.any(0))
            if not len(cols):
                continue
            got = (q[who] @ forward[x][:, cols]).astype(np.int64)
            scored += int(ok.sum())
            asked.gather(rows, got, ok[:, cols], b.ids[cols])
    return scored, pairs


def prepare(vectors: DataFrame, label: Column, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    return rows.select("vec_id", label.cast("long").alias("label"), F.transform("v", lambda x: F.floor(x * scale)).alias("v")).filter("label IS NOT NULL")


def measured(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with ``norm``, ``angles`` and ``near``, the nearest direction; and the width of vectors."""
    wide = rows.agg(F.max(F.size("v"))).first()[0] or 0
    sample = [r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(DIRECTIONS).select("v").collect()]
    m = np.array([r + [0] * (wide - len(r)) for r in sample], np.float64).reshape(len(sample), wide)
    norms = np.linalg.norm(m, axis=1)
    directions = m[norms > 0] / norms[norms > 0, None]

    def measure(batches):
        for batch in batches:
            m = matrix(batch.column("v"), batch.num_rows, wide)
            norms = np.sqrt((m.astype(np.float64) ** 2).sum(1))
            angles = angles_to(m, norms, directions)
            near = angles.argmin(1) if len(directions) else np.zeros(len(m), np.int64)
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "v": batch.column("v"), "norm": pa.array(norms),
                                   "angles": pa.array([a.tobytes() for a in angles], pa.binary()), "near": pa.array(near.astype(np.int32))})

    kept, _ = stored(rows.mapInArrow(measure, "vec_id long, label long, v array<long>, norm double, angles binary, near int"), "vectors")
    return kept, wide


def block_table(rows: DataFrame, wide: int, n_groups: int) -> DataFrame:
    """Blocks of rows of one label and one nearest direction, as far as these have enough rows: ``g``, and each row's parts as bytes."""
    kinds = {"g": "int", "n": "int", "ids": "binary", "labels": "binary", "kind": "string", "v": "binary", "norms": "binary", "angles": "binary"}
    schema = pa.schema([(c, {"int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[k]) for c, k in kinds.items()])

    def one(t: pa.Table, g: int) -> dict:
        m = integers(matrix(t.column("v"), t.num_rows, wide))
        return {"g": g, "n": t.num_rows, "ids": t.column("vec_id").to_numpy().tobytes(), "labels": t.column("label").to_numpy().tobytes(),
                "kind": m.dtype.str, "v": m.tobytes(), "norms": t.column("norm").to_numpy().tobytes(), "angles": b"".join(t.column("angles").to_pylist())}

    def block(batches):
        held, g = None, TaskContext.get().partitionId()
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            full = held.num_rows // BLOCK * BLOCK
            if full:
                yield pa.RecordBatch.from_pylist([one(held.slice(at, BLOCK), g) for at in range(0, full, BLOCK)], schema)
            held = held.slice(full)
        if held is not None and held.num_rows:
            yield pa.RecordBatch.from_pylist([one(held, g)], schema)

    # an id that repeats without end is split by its rows' places
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    order = ["label", "near", "vec_id", "place"]
    ranged = placed.repartitionByRange(n_groups, *order).sortWithinPartitions("label", "near", "norm", "vec_id").drop("place")
    blocks, _ = stored(ranged.mapInArrow(block, ", ".join(map(" ".join, kinds.items()))), "blocks")
    return blocks


def grid(blocks: DataFrame, asked: DataFrame, n_packs: int, cell: Callable, schema: str) -> DataFrame:
    """``cell(blocks, anchors)`` for every group of blocks and group of anchors."""
    last = blocks.agg(F.max("g")).first()[0] or 0
    left = blocks.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1))))
    right = asked.withColumn("p", F.pmod(F.hash("vec_id"), F.lit(n_packs))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(last))))
    return left.groupBy("g", "p").cogroup(right.groupBy("g", "p")).applyInArrow(cell, schema)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank``: for each id with
    ``is_anchor`` (a column over ``vec_id``) its ``positives`` best rows of its own label, and for each of these the
    ``negatives`` best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    Scores are integer inner products of floor(scale * component); ties go to the smaller id.  ``label`` is the label
    in use, a column over ``vec_id`` and ``label``.

    Rows without id or label and vectors that are null or hold a null or non-finite component take no part; shorter
    vectors count as filled up with zeros.  An id that repeats is one anchor (its smallest label and vector) and as
    many candidates as rows; rows with an anchor's own id are none of its candidates.  Too few rows give fewer
    results, an empty table none.  Scores must fit a long.  Other columns aren't read.
    """
    rows, wide = measured(prepare(vectors, F.col("label") if label is None else label, scale, id_col, label_col, vector_col))
    blocks = block_table(rows, wide, max(1, -(-rows.count() // GROUP)))
    anchors, _ = stored(rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v", "norm", "angles")).alias("a")).select("vec_id", "a.*"), "anchors")
    n_packs = max(1, -(-anchors.count() // ANCHORS))

    def run(left: pa.Table, right: pa.Table, k: int, windows: list, same_label: bool) -> tuple:
        """Places (anchor, window, nth) of what a cell gathers, and the anchors."""
        if not left.num_rows or not right.num_rows:
            return (np.empty(0, np.int64),) * 5
        asked = Asked(right, wide, k, windows)
        search_cell([Block(b, wide) for b in left.to_pylist()], asked, same_label)
        i, j, at = np.nonzero(asked.names < LAST)
        return i, j, asked.ids[i], asked.names[i, j, at], asked.scores[i, j, at]

    def positive_cell(left: pa.Table, right: pa.Table) -> pa.Table:
        _, _, anchor, name, score = run(left, right, positives, [[(NONE + 1, LAST)]] * right.num_rows, True)
        return pa.table({"anchor_id": anchor, "positive_id": name, "positive_score": score})

    best = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = (grid(blocks, anchors, n_packs, positive_cell, "anchor_id long, positive_id long, positive_score long")
             .withColumn("positive_rank", F.row_number().over(best)).filter(F.col("positive_rank") <= positives))
    # at most ``positives`` rows an anchor
    found, _ = stored(found, "positives")
    listed = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("positive_rank", "positive_score"))).alias("wanted"))
    asked = anchors.join(listed, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")

    def negative_cell(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = right.column("wanted").to_pylist()
        # 100 * n between low * p and high * p
        windows = [[(-(-low * w["positive_score"] // 100), high * w["positive_score"] // 100) for w in one] for one in wanted]
        i, j, anchor, name, score = run(left, right, negatives, windows, False)
        ranks = [wanted[a][b]["positive_rank"] for a, b in zip(i.tolist(), j.tolist())]
        return pa.table({"anchor_id": anchor, "positive_rank": pa.array(ranks, pa.int32()), "negative_id": name, "negative_score": score})

    w = W.partitionBy("anchor_id", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
    hard = (grid(blocks, asked, n_packs, negative_cell, "anchor_id long, positive_rank int, negative_id long, negative_score long")
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= negatives))
    return hard.join(found, ["anchor_id", "positive_rank"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", "positive_rank")
