"""Order-dependent per-recording computations that survive hot recordings.

As long as no recording has more than ``chunk_rows`` rows (a count decides:
``chunk_if_hot``), events carry no ``_chunk`` column and every helper is a plain,
lazy window over the recording: all helpers of a flow share one exchange.

A recording that may hold a third of all events must not go through one
task.  Then events carry ``_chunk``, which is non-decreasing in ``ord`` within a
recording and bounds the rows per (recording, chunk), and each result is
assembled in two levels:

1. a window partitioned by ``(keys, _chunk)`` computes the chunk-local value;
2. a per-chunk summary (one row per chunk: last row, totals) is
   shifted/prefix-summed with a window over ``keys`` ordered by ``_chunk`` and
   joined back on ``(keys, _chunk)``.

The join in step 2 uses exactly the window's partitioning keys, so only the
summary side is shuffled (or broadcast by AQE when its runtime size is small);
the event side keeps its hash partitioning across chained calls.  Chunks are
ranges of the dense ``ord``, so a recording below the bound is one chunk and
the summary stays one row for it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK = "_chunk"
# Rows per (recording, chunk).  ~1M events of a few hundred bytes keeps one
# window partition around a few hundred MB at most, far below executor memory.
DEFAULT_CHUNK_ROWS = 1 << 20


def add_chunk(df: DataFrame, order_col: str, chunk_rows: int = DEFAULT_CHUNK_ROWS,
              out: str = CHUNK) -> DataFrame:
    """``out = order_col div chunk_rows``.  ``order_col`` must be integral and
    unique within a recording so that a chunk holds at most ``chunk_rows`` rows."""
    return df.withColumn(out, F.expr(f"cast(`{order_col}` as bigint) div {int(chunk_rows)}"))


def hot_keys(df: DataFrame, keys: Sequence[str] | str, chunk_rows: int) -> DataFrame:
    """Keys with more than ``chunk_rows`` rows: fewer than rows / ``chunk_rows`` of them."""
    return df.groupBy(*_keys(keys)).agg(F.count("*").alias("__n")).filter(F.col("__n") > chunk_rows).drop("__n")


def chunk_if_hot(df: DataFrame, keys: Sequence[str] | str, order_col: str, chunk_rows: int = DEFAULT_CHUNK_ROWS,
                 chunk: str = CHUNK) -> DataFrame:
    """Add ``_chunk`` only if some key has more than ``chunk_rows`` rows; then other keys are one chunk each."""
    keys = _keys(keys)
    hot = hot_keys(df, keys, chunk_rows)
    if hot.isEmpty():
        return df
    out = df.join(hot.withColumn("__hot", F.lit(True)), keys, "left")
    part = F.expr(f"cast(`{order_col}` as bigint) div {int(chunk_rows)}")
    return out.withColumn(chunk, F.when(F.col("__hot"), part).otherwise(F.lit(0).cast("long"))).drop("__hot")


def chunk_cols(df: DataFrame, chunk: str = CHUNK) -> list[str]:
    return [chunk] if chunk in df.columns else []


_STAGED: list[tuple[str, str]] = []


def stage(df: DataFrame, keys: list[str], chunk: str = CHUNK, dealt: bool = False) -> DataFrame:
    """Start an ordered stage: write the input as a table bucketed on
    ``(keys, chunk)`` under the shared checkpoint folder and read it back.

    Each helper reads its input twice (chunk-local window + per-chunk
    summary) and the helpers chain, so without a cut the plan tree and the
    work would double per helper.  The written table

    * cuts the lineage (small plans; a lost executor re-reads files instead
      of recomputing the upstream job),
    * is read with its bucket hash partitioning, so the window, the summary
      aggregate and the summary join on ``(keys, chunk)`` add no exchange on
      the event side: one shuffle per stage, in the write.

    ``dealt``: the rows lie as an earlier stage on the same keys and chunk dealt
    them, so they are written where they are, without another exchange.
    """
    from clickloom.session import scratch_path

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "clickloom_stage_" + uuid.uuid4().hex[:16]
    cols = [F.col(k) for k in keys] + [F.col(chunk)]
    path = scratch_path(spark, name)
    df = df if dealt else df.repartition(n, *cols)
    (df.write.format("parquet").bucketBy(n, *keys, chunk)
       .option("path", path).saveAsTable(name))
    _STAGED.append((name, path))
    return spark.table(name)


def release_stages(spark=None) -> None:
    """Drop the stage tables created so far, files included (after the results are consumed)."""
    from pyspark.sql import SparkSession

    from clickloom.session import delete_path

    spark = spark or SparkSession.getActiveSession()
    while _STAGED:
        name, path = _STAGED.pop()
        if spark is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_path(spark, path)


def _keys(keys: Sequence[str] | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _ord_col(ord: Sequence[str] | str) -> Column:
    o = _keys(ord)
    return F.col(o[0]) if len(o) == 1 else F.struct(*[F.col(c) for c in o])


def with_adjacent(df: DataFrame, prev: Sequence[str] = (), nxt: Sequence[str] = (),
                  keys: Sequence[str] | str = "rec_id", ord: Sequence[str] | str = "ord",
                  chunk: str = CHUNK, prev_prefix: str = "prev_",
                  next_prefix: str = "next_") -> DataFrame:
    """Add ``prev_<c>`` / ``next_<c>``: the value of the previous / next row by
    ``ord`` within the recording (null at the recording's first / last row)."""
    keys = _keys(keys)
    prev, nxt = list(prev), list(nxt)
    w = W.partitionBy(*keys, chunk).orderBy(*_keys(ord))
    cols = []
    if prev:
        pp = F.struct(*[F.col(c) for c in prev])
        cols.append(F.lag(pp).over(w).alias("__lag"))
    if nxt:
        np_ = F.struct(*[F.col(c) for c in nxt])
        cols.append(F.lead(np_).over(w).alias("__lead"))
    if not cols:
        return df
    if chunk not in df.columns:
        w = W.partitionBy(*keys).orderBy(*_keys(ord))
        near = df.select("*", *([F.lag(pp).over(w).alias("__lag")] if prev else []), *([F.lead(np_).over(w).alias("__lead")] if nxt else []))
        return near.select("*", *[F.col("__lag")[c].alias(prev_prefix + c) for c in prev],
                           *[F.col("__lead")[c].alias(next_prefix + c) for c in nxt]).drop("__lag", "__lead")
    local = stage(df, keys, chunk).select("*", *cols)

    aggs = []
    if prev:
        aggs.append(F.max_by(pp, _ord_col(ord)).alias("__last"))
    if nxt:
        aggs.append(F.min_by(np_, _ord_col(ord)).alias("__first"))
    summary = local.groupBy(*keys, chunk).agg(*aggs)
    wc = W.partitionBy(*keys).orderBy(chunk)
    carry_cols = []
    if prev:
        carry_cols.append(F.lag("__last").over(wc).alias("__carry_prev"))
    if nxt:
        carry_cols.append(F.lead("__first").over(wc).alias("__carry_next"))
    carry = summary.select(*keys, chunk, *carry_cols)

    out = local.join(carry, [*keys, chunk], "left")
    new_cols = []
    if prev:
        p = F.coalesce(F.col("__lag"), F.col("__carry_prev"))
        new_cols += [p[c].alias(prev_prefix + c) for c in prev]
    if nxt:
        n = F.coalesce(F.col("__lead"), F.col("__carry_next"))
        new_cols += [n[c].alias(next_prefix + c) for c in nxt]
    drop = [c for c in ("__lag", "__lead", "__carry_prev", "__carry_next")]
    return out.select("*", *new_cols).drop(*drop)


def with_running(df: DataFrame, specs: dict[str, tuple[Column, str]],
                 keys: Sequence[str] | str = "rec_id", ord: Sequence[str] | str = "ord",
                 chunk: str = CHUNK, inclusive: bool = True) -> DataFrame:
    """Running aggregates over ``ord`` within each recording.

    ``specs`` maps output name -> (value column, "sum" | "max").  With
    ``inclusive=False`` a sum covers only the preceding rows.
    """
    keys = _keys(keys)
    fn = {"sum": F.sum, "max": F.max}
    if chunk not in df.columns:
        w = W.partitionBy(*keys).orderBy(*_keys(ord)).rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1)
        run = {n: fn[how](col).over(w) for n, (col, how) in specs.items()}
        return df.select("*", *[(F.coalesce(r, F.lit(0)) if specs[n][1] == "sum" else r).alias(n) for n, r in run.items()])
    w = W.partitionBy(*keys, chunk).orderBy(*_keys(ord)).rowsBetween(W.unboundedPreceding, W.currentRow)
    vals = {name: (f"__v_{i}", col, how) for i, (name, (col, how)) in enumerate(specs.items())}
    local = stage(df, keys, chunk).select("*", *[col.alias(v) for v, col, _ in vals.values()])
    local = local.select("*", *[fn[how](F.col(v)).over(w).alias(v + "_loc")
                                for v, _, how in vals.values()])
    summary = local.groupBy(*keys, chunk).agg(*[fn[how](F.col(v)).alias(v + "_tot")
                                               for v, _, how in vals.values()])
    wc = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    offs = summary.select(*keys, chunk, *[fn[how](F.col(v + "_tot")).over(wc).alias(v + "_off")
                                          for v, _, how in vals.values()])
    out = local.join(offs, [*keys, chunk], "left")
    res = []
    for name, (v, _, how) in vals.items():
        if how == "sum":
            r = F.coalesce(F.col(v + "_off"), F.lit(0)) + F.col(v + "_loc")
            if not inclusive:
                r = r - F.coalesce(F.col(v), F.lit(0))
        else:
            r = F.greatest(F.col(v + "_off"), F.col(v + "_loc"))
        res.append(r.alias(name))
    tmp = [c for v, _, _ in vals.values() for c in (v, v + "_loc", v + "_off")]
    return out.select("*", *res).drop(*tmp)


def dense_ordinal(df: DataFrame, keys: Sequence[str] | str, order_col: str, out: str = "ord",
                  chunk_rows: int = DEFAULT_CHUNK_ROWS, chunk: str = CHUNK) -> DataFrame:
    """1-based ``row_number()`` over ``order_col`` within ``keys`` without a
    single-task window per key: chunk by ``order_col`` ranges, number rows
    inside each chunk, add the row counts of the preceding chunks.  Without a
    ``_chunk`` column one is added only if a key is above ``chunk_rows``, and
    the result has none."""
    keys = _keys(keys)
    if chunk not in df.columns:
        df = chunk_if_hot(df, keys, order_col, chunk_rows, chunk)
        if chunk not in df.columns:
            return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(order_col)).cast("long"))
        return dense_ordinal(df, keys, order_col, out, chunk_rows, chunk).drop(chunk)
    return with_running(df, {out: (F.lit(1).cast("long"), "sum")}, keys=keys,
                        ord=order_col, chunk=chunk)


def with_prev_running(df: DataFrame, prev: Sequence[str], cur: Sequence[str], running: dict,
                      nxt: Sequence[str] = (), keys: Sequence[str] | str = "rec_id",
                      ord: Sequence[str] | str = "ord", chunk: str = CHUNK,
                      prev_prefix: str = "prev_", next_prefix: str = "next_", dealt: bool = False) -> DataFrame:
    """``with_adjacent`` and ``with_running`` fused into one stage, for running
    aggregates whose per-row value depends on the previous row.

    ``running`` maps name -> (fn, "sum" | "max") with ``fn(c, p) -> Column``,
    where ``c(name)`` / ``p(name)`` give the current / previous row's value of a
    column listed in ``cur`` / ``prev``.  Each chunk's first row is valued
    with a local guess (no predecessor) and corrected in the per-chunk
    summary, where the carried predecessor is known; one summary join then
    delivers neighbours and offsets together.  ``dealt`` as in ``stage``."""
    keys = _keys(keys)
    prev, nxt = list(prev), list(nxt)
    if chunk not in df.columns:
        df = with_adjacent(df, prev, nxt, keys, ord, chunk, prev_prefix, next_prefix)
        value = {n: (fn(F.col, lambda c: F.col(prev_prefix + c)), how) for n, (fn, how) in running.items()}
        return with_running(df, value, keys, ord, chunk)
    cur = list(dict.fromkeys(list(cur) + [chunk]))
    w = W.partitionBy(*keys, chunk).orderBy(*_keys(ord))
    fns = {"sum": F.sum, "max": F.max}
    pp = F.struct(*[F.col(c) for c in prev])
    local = stage(df, keys, chunk, dealt).select("*", F.lag(pp).over(w).alias("__lag"),
                                                 *([F.lead(F.struct(*[F.col(c) for c in nxt])).over(w).alias("__lead")] if nxt else []))
    is_first = F.col("__lag").isNull()
    row_c = lambda n: F.col(n)
    row_p = lambda n: F.col("__lag")[n]
    vals = {name: (f"__r{i}", fn, how) for i, (name, (fn, how)) in enumerate(running.items())}
    local = local.select("*", *[fn(row_c, row_p).alias(v) for v, fn, _ in vals.values()])

    aggs = [F.max_by(pp, _ord_col(ord)).alias("__last"),
            F.min_by(F.struct(*[F.col(c) for c in cur]), _ord_col(ord)).alias("__first")]
    if nxt:
        aggs.append(F.min_by(F.struct(*[F.col(c) for c in nxt]), _ord_col(ord)).alias("__first_next"))
    aggs += [fns[how](F.when(~is_first, F.col(v))).alias(v + "_rest") for v, _, how in vals.values()]
    summary = local.groupBy(*keys, chunk).agg(*aggs)
    wc = W.partitionBy(*keys).orderBy(chunk)
    carry = summary.select("*", F.lag("__last").over(wc).alias("__carry_prev"),
                           *([F.lead("__first_next").over(wc).alias("__carry_next")] if nxt else []))
    sum_c = lambda n: F.col("__first")[n]
    sum_p = lambda n: F.col("__carry_prev")[n]
    first_vals = [fn(sum_c, sum_p).alias(v + "_first") for v, fn, _ in vals.values()]
    carry = carry.select("*", *first_vals)
    tot = []
    for v, _, how in vals.values():
        if how == "sum":
            tot.append((F.coalesce(F.col(v + "_rest"), F.lit(0)) + F.coalesce(F.col(v + "_first"), F.lit(0))).alias(v + "_tot"))
        else:
            tot.append(F.greatest(F.col(v + "_rest"), F.col(v + "_first")).alias(v + "_tot"))
    carry = carry.select("*", *tot)
    wp = wc.rowsBetween(W.unboundedPreceding, -1)
    carry = carry.select(*keys, chunk, "__carry_prev", *(["__carry_next"] if nxt else []),
                         *[F.col(v + "_first") for v, _, _ in vals.values()],
                         *[fns[how](F.col(v + "_tot")).over(wp).alias(v + "_off") for v, _, how in vals.values()])

    out = local.join(carry, [*keys, chunk], "left")
    fixed = [F.when(is_first, F.col(v + "_first")).otherwise(F.col(v)).alias(v) for v, _, _ in vals.values()]
    keep = [c for c in out.columns if c not in {v for v, _, _ in vals.values()}]
    out = out.select(*keep, *fixed)
    wr = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    res = []
    for name, (v, _, how) in vals.items():
        if how == "sum":
            res.append((F.coalesce(F.col(v + "_off"), F.lit(0)) + F.sum(F.col(v)).over(wr)).alias(name))
        else:
            res.append(F.greatest(F.col(v + "_off"), F.max(F.col(v)).over(wr)).alias(name))
    p = F.coalesce(F.col("__lag"), F.col("__carry_prev"))
    cols = [p[c].alias(prev_prefix + c) for c in prev]
    if nxt:
        n = F.coalesce(F.col("__lead"), F.col("__carry_next"))
        cols += [n[c].alias(next_prefix + c) for c in nxt]
    tmp = ["__lag", "__lead", "__carry_prev", "__carry_next"] + [c for v, _, _ in vals.values()
                                                                 for c in (v, v + "_first", v + "_off")]
    return out.select("*", *cols, *res).drop(*tmp)
