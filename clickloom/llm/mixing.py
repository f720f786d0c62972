"""Mixing sources to target weights by Pareto order sampling (native).

Targets are shares of the words in the mix, water-filled under a ceiling of a
given number of epochs per source.  A source whose target is r times its size
gives every document floor(r) certain whole copies.  The rest, a share p =
r - floor(r) of its words, is a fixed-size sample: Pareto sampling ranks by
random odds over inclusion odds, q = (u/(1-u)) / (p/(1-p)); p is one value for
a source, so that is the order of u, a random order per source.  Documents are
taken in it up to the first that does not fit the words that remain; one more
document, the unchosen one whose size comes nearest to what is still missing,
narrows the gap, which a very long document can leave wide.  Random numbers are
hashes of the id, so reruns agree.

Running sums go over 4,096 bins of u per source, so a hot source is ranked by
many tasks.  Only the table of sources (one row a source) is ordered in one
task: weights repeat by the source's place in code-point order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from clickloom.llm.common import attach, materialize
from clickloom.llm.sharding import BINS, numbered

#: Words: runs of anything but space and the ASCII control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: ``share`` times all words dealt out by
    weight, no source above ``epochs`` times its size, the excess reshared until none is."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.lit(weights[0])
    for i, x in enumerate(weights[1:], 1):
        weight = F.when(F.col("place") == i, F.lit(x)).otherwise(weight)
    t = sizes.withColumn("place", place).withColumn("weight", weight.cast("long")).withColumn("ceiling", F.col("source_size") * epochs)
    by_ratio = W.orderBy((F.col("ceiling") / F.col("weight")), "place", F.col("source").asc_nulls_last())
    t = t.withColumns({
        "row": F.row_number().over(by_ratio),
        "full_before": F.coalesce(F.sum("ceiling").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "weight_from": F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)),
        "total": F.sum("source_size").over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    t = t.withColumn("level", (F.col("total") * share - F.col("full_before")) / F.col("weight_from"))
    below = F.col("level") * F.col("weight") < F.col("ceiling")
    t = t.withColumn("first", F.min(F.when(below, F.struct("row", "level"))).over(W.partitionBy(F.lit(1))))
    target = F.when(F.col("first").isNull() | (F.col("row") < F.col("first.row")), F.col("ceiling").cast("double")).otherwise(
        F.least(F.col("first.level") * F.col("weight"), F.col("ceiling").cast("double")))
    return t.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken, copies, source``.

    ``size`` counts words (null text: 0), ``copies`` is 0 to ``epochs``, ``taken`` = size x
    copies.  A null source is a source, ordered last.  A null id draws like the empty id; rows
    with equal ids draw equally and are told apart by their place in the order.  Empty texts
    take no words whatever their copies.  Empty tables give empty results.
    """
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10)
         .cast("double") + 0.5) / float(1 << 52)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), u.alias("u"))
    rows = materialize(rows.withColumn("bin", F.floor(F.col("u") * BINS).cast("int")))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    targets = materialize(targets.withColumn("whole", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(
        F.floor(F.col("target") / F.col("source_size")))).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    ranked = numbered(rows, ["source"], "bin", [F.col("u"), F.col("doc_id"), F.col("size")], "place", running={"upto": "size"})
    told = targets.select(F.col("source").alias("s"), "source_size", "target", "whole", "rest",
                          (F.col("rest") / F.greatest(F.col("source_size"), F.lit(1))).alias("p"))
    ranked = ranked.join(told, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = ranked.withColumn("q", F.when((F.col("p") > 0) & (F.col("p") < 1), odds))
    ranked = materialize(ranked.withColumn("sampled", (F.col("rest") > 0) & (F.col("upto") <= F.col("rest"))).drop("bin", "u"))
    gaps = ranked.groupBy("source").agg(
        (F.first("rest") - F.coalesce(F.max(F.when(F.col("sampled"), F.col("upto"))), F.lit(0))).alias("gap"))
    gaps = gaps.select(F.col("source").alias("s"), "gap")
    spare = ranked.filter(~F.col("sampled") & (F.col("size") > 0)).join(gaps, F.col("source").eqNullSafe(F.col("s")))
    off = F.abs(F.col("gap") - F.col("size"))
    last = (spare.filter(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "place")).alias("m"))
            .select(F.col("source").alias("s"), F.col("m.place").alias("last")))
    out = ranked.join(last, F.col("source").eqNullSafe(F.col("s")), "left")
    copies = F.col("whole") + F.when(F.col("sampled") | F.coalesce(F.col("place") == F.col("last"), F.lit(False)), 1).otherwise(0)
    out = out.withColumn("copies", copies.cast("int"))
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"),
                      (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "source")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, unchanged."""
    decided = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).filter("copies > 0")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    out = attach(docs, {"doc_id": F.col(id_col), "source": F.col(source_col), "size": size}, decided, ["copies"])
    return (out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__v.copies")))).select(*docs.columns))
