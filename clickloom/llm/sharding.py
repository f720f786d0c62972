"""Sharding by proportional stratified interleaving (native).

Rows of each source are put in a seeded random order; row r of n gets the
fractional rank (r + u)/n, u being a seeded number of the source, so that small
sources don't all fall in the middle; all rows are sorted by it and the sorted
sequence is cut into contiguous shards whose row counts differ by at most one
(law ``rows``).  Every stretch of ranks holds each source in its share of the
whole to within one row, and so, nearly, does every shard.

No order is taken in one task.  A rank within a source, and a position in the
whole, is a prefix sum over 4,096 bins of the sort key (one row a bin, or a bin
and source) plus a row number inside the bin, so a source with a third of all
rows is numbered by thousands of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clickloom.llm.common import attach, materialize

BINS = 4096


def numbered(df: DataFrame, keys: list[str], bin_col: str, order: list[Column], out: str,
             total: str | None = None, running: dict[str, str] | None = None) -> DataFrame:
    """Add ``out``: the 0-based rank of each row within ``keys`` (null is a key
    of its own) in the order of (``bin_col``, ``order``).  ``total`` names the
    rows a key has; ``running`` maps new names to columns whose inclusive
    running sums are added."""
    running = running or {}
    w = W.partitionBy(*keys).orderBy(bin_col).rowsBetween(W.unboundedPreceding, -1)
    bins = df.groupBy(*keys, bin_col).agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__t_{o}") for o, c in running.items()])
    bins = bins.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, bin_col])],
        F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"),
        *[F.coalesce(F.sum(f"__t_{o}").over(w), F.lit(0)).alias(f"__off_{o}") for o in running],
        *([F.sum("__n").over(W.partitionBy(*keys)).alias(total)] if total else []))
    on = None
    for i, k in enumerate([*keys, bin_col]):
        same = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        on = same if on is None else on & same
    inside = W.partitionBy(*keys, bin_col).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (df.join(bins, on)
            .withColumns({out: F.col("__off") + F.row_number().over(inside) - 1,
                          **{o: F.col(f"__off_{o}") + F.sum(c).over(upto) for o, c in running.items()}})
            .drop("__off", *[f"__k{i}" for i in range(len(keys) + 1)], *[f"__off_{o}" for o in running]))


def interleave(docs: DataFrame, n_shards: int, stratum: str = "source", id_col: str = "doc_id",
               text_col: str = "text", seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, shard, slot, stratum``.

    ``size`` is the UTF-8 bytes of the text plus 8; a null text has none and the
    crc of the empty text.  A null stratum is a stratum of its own; null ids and
    repeated rows are rows like others (equal rows are interchangeable).  An
    empty table gives an empty result; fewer rows than shards leave shards
    empty.  Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum).alias("stratum"),
                       (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    rows = materialize(rows.withColumn("bin", F.shiftrightunsigned("h", 52).cast("int")))
    ties = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = numbered(rows, ["stratum"], "bin", [F.col("h"), *ties], "r", total="n")
    start = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col("stratum").isNull(), "stratum"), 32).cast("double") / float(1 << 32)
    ranked = ranked.withColumn("frac", (F.col("r").cast("double") + start) / F.col("n").cast("double"))
    ranked = materialize(ranked.select("doc_id", "stratum", "size", "text_crc32", "frac",
                                       F.floor(F.col("frac") * BINS).cast("int").alias("fbin"), F.lit(0).alias("all")))
    placed = numbered(ranked, ["all"], "fbin", [F.col("frac"), F.col("stratum").asc_nulls_last(), *ties], "pos", total="n")
    shard = F.expr(f"pos * {n_shards} div n")
    first = F.expr(f"(shard * n + {n_shards - 1}) div {n_shards}")
    return (placed.withColumn("shard", shard).withColumn("slot", F.col("pos") - first)
            .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), "stratum"))


def sharded(docs: DataFrame, n_shards: int, stratum: str = "source", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with their ``shard`` and ``slot`` (in place of columns of these names)."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    out = attach(docs, {"doc_id": F.col(id_col), "stratum": F.col(stratum), "text_crc32": F.crc32(text), "size": (F.octet_length(text) + 8).cast("long")},
                 interleave(docs, n_shards, stratum, id_col, text_col, **options), ["shard", "slot"])
    return out.select(*[c for c in docs.columns if c not in ("shard", "slot")], "__v.shard", "__v.slot")


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """``interleave`` under the law ``rows``; growing the shard count moves rows, so ``grown_shard`` is null."""
    return interleave(docs, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
