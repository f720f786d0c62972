"""Exact top-k search by block-at-a-time pruning.

Vectors become integers; a term is a signed dimension.  Rows are laid out in
document-range blocks of similar vectors, each with a forward index (its
integer matrix) and the maximum of every term.  A query sums its term maxima to
bound each block, visits blocks in falling order of bound, scores them through
their forward indexes, and stops when the bound falls below its k-th score.

The queries are a stated share of all rows, so the work is a grid: groups of
blocks against groups of queries, each cell one task with bounded memory.
Every cell gives k rows a query; a window merges them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clickloom.llm.common import materialize

BLOCK = 256
#: Vectors in a group of blocks, and queries in a group of queries: what one task holds.
GROUP = 16_384
#: Queries that go through the blocks together.
PACK = 256
#: Bits of the sign sketch that brings similar vectors together.
SKETCH = 16
NONE = np.iinfo(np.int64).min


def matrix(column: pa.ChunkedArray | pa.Array, rows: int, width: int | None = None) -> np.ndarray:
    """A list<long> column as a matrix, shorter rows filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = column.value_lengths().to_numpy(zero_copy_only=False) if rows else np.empty(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    wide = max(int(n.max()) if rows else 0, width or 0)
    out = np.zeros((rows, wide), np.int64)
    out[np.arange(wide) < n[:, None]] = flat
    return out


def exact(*parts: np.ndarray) -> type:
    """A type in which products of these matrices are exact."""
    size = float(parts[0].shape[1])
    for m in parts:
        size *= float(np.abs(m).max()) if m.size else 0.0
    return np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else np.int64


def search_cell(query_ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (score, id) of each query among the blocks' rows, and how many blocks were scored in all."""
    wide = max([queries.shape[1], *(m.shape[1] for _, m in blocks)])
    fill = lambda m: np.pad(m, ((0, 0), (0, wide - m.shape[1])))
    queries, blocks = fill(queries), [(ids, fill(m)) for ids, m in blocks]
    top = np.stack([m.max(0) for _, m in blocks])
    low = np.stack([m.min(0) for _, m in blocks])
    kind = exact(queries, np.maximum(np.abs(top), np.abs(low)))
    forward = [m.astype(kind).T for _, m in blocks]
    best = np.full((len(queries), k), NONE)
    named = np.full((len(queries), k), np.iinfo(np.int64).max)
    scored = 0
    for at in range(0, len(queries), PACK):
        q = queries[at:at + PACK].astype(kind)
        own = query_ids[at:at + PACK]
        # a positive weight meets the largest value of its dimension, a negative one the smallest
        bound = (np.maximum(q, 0) @ top.T.astype(kind) + np.minimum(q, 0) @ low.T.astype(kind)).astype(np.int64)
        order = np.argsort(-bound, axis=1, kind="stable")
        s, n = best[at:at + PACK], named[at:at + PACK]
        for j in range(len(blocks)):
            b = order[:, j]
            active = bound[np.arange(len(q)), b] >= s[:, -1]
            if not active.any():
                break  # bounds only fall and k-th scores only rise
            for x in np.unique(b[active]):
                who = np.flatnonzero(active & (b == x))
                ids = blocks[x][0]
                got = (q[who] @ forward[x]).astype(np.int64)
                got[ids[None, :] == own[who, None]] = NONE
                scored += len(who)
                all_s = np.concatenate([s[who], got], 1)
                all_n = np.concatenate([n[who], np.broadcast_to(ids, got.shape)], 1)
                pick = np.lexsort((all_n, -np.maximum(all_s, NONE + 1)), axis=1)[:, :k]
                s[who], n[who] = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_n, pick, 1)
    return best, named, scored


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
           vector_col: str = "embedding", seed: int = 11) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id with ``is_query`` (a column over ``vec_id``) the ``k`` rows of
    highest integer inner product of floor(scale * component), ties to the smaller id.

    Vectors that are null or hold a null or non-finite component, and rows without id, take no part; shorter vectors
    count as filled up with zeros.  Rows with a query's own id are no candidates of it; an id that repeats is one
    query (its smallest vector) and as many candidates as rows.  Fewer rows than ``k`` give fewer results, an empty
    table none.  Scores must fit a long.
    """
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok)
            .withColumn("v", F.transform("v", lambda x: F.floor(x * scale))))

    def sketch(batches):
        for batch in batches:
            m = matrix(batch.column("v"), batch.num_rows).astype(np.float64)
            planes = np.random.default_rng(seed).standard_normal((m.shape[1], SKETCH)) if m.shape[1] else np.zeros((0, SKETCH))
            bits = ((m @ planes) > 0) @ (1 << np.arange(SKETCH))
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "v": batch.column("v"), "near": pa.array(bits, pa.int64())})

    rows = materialize(rows.mapInArrow(sketch, "vec_id long, v array<long>, near long"))
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_groups = max(1, -(-rows.count() // GROUP))
    n_packs = max(1, -(-queries.count() // GROUP))

    def block(batches):
        held: list[pa.RecordBatch] = []
        g, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK:
                t = pa.Table.from_batches(held)
                yield one(t.slice(0, BLOCK), g, no)
                held, no = t.slice(BLOCK).to_batches(), no + 1
        if sum(b.num_rows for b in held):
            yield one(pa.Table.from_batches(held), g, no)

    def one(t, g, no):
        return pa.RecordBatch.from_pylist(
            [{"g": g, "no": no, "ids": t.column("vec_id").to_pylist(), "vs": t.column("v").to_pylist()}],
            pa.schema([("g", pa.int32()), ("no", pa.int32()), ("ids", pa.list_(pa.int64())), ("vs", pa.list_(pa.list_(pa.int64())))]))

    blocks = (rows.repartitionByRange(n_groups, "near", "vec_id").sortWithinPartitions("near", "vec_id")
              .mapInArrow(block, "g int, no int, ids array<long>, vs array<array<long>>"))
    blocks = blocks.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1))))
    asked = (queries.withColumn("p", F.pmod(F.hash("vec_id"), F.lit(n_packs)))
             .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            cells = []
            for ids, vs in zip(left.column("ids").to_pylist(), left.column("vs"), strict=True):
                cells.append((np.array(ids, np.int64), matrix(vs.values, len(ids))))
            qid = right.column("vec_id").to_numpy()
            best, named, _ = search_cell(qid, matrix(right.column("v"), right.num_rows), cells, k)
            hit = best > NONE
            out = {"query_id": np.repeat(qid, hit.sum(1)), "vec_id": named[hit], "score": best[hit]}
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    found = blocks.groupBy("g", "p").cogroup(asked.groupBy("g", "p")).applyInArrow(cell, "query_id long, vec_id long, score long")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
