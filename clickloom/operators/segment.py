"""Segmentation: weighted boundary signals between consecutive events,
cuts where the weight reaches the threshold, and the segment cap."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from clickloom import model
from clickloom.functions.scalars import json_field, json_is_object, verb_group
from clickloom.plans.ordered import CHUNK, with_adjacent, with_prev_running, with_running
from clickloom.session import scratch_path

PREV_COLS = ["type", "__url", "ts_ms", "__verb"]
CUR_COLS = ["type", "__url", "ts_ms", "__verb", "__enter", "__submit"]
SIGNALS = ["sig_navigate", "sig_url_change", "sig_focus_tab", "sig_form_submit", "sig_enter_after_input",
           "sig_network_idle", "sig_screen_changed", "sig_gap", "sig_verb_change"]


def _signals(c, p, gap_ms: int):
    """D1..D9 for a row ``c`` and its predecessor ``p`` (getters by column name)."""
    has_prev = p("type").isNotNull()
    t, pt = c("type"), p("type")
    url, purl = c("__url"), p("__url")
    nonempty = lambda x: x.isNotNull() & (x != "")
    gap = c("ts_ms") - p("ts_ms")
    sig = {
        "sig_navigate": F.when(t == "navigate", 3),
        "sig_url_change": F.when((t != "navigate") & nonempty(url) & nonempty(purl) & (url != purl), 3),
        "sig_focus_tab": F.when(t.isin(*model.FOCUS_TAB_TYPES), 3),
        "sig_form_submit": F.when(c("__submit"), 3),
        "sig_enter_after_input": F.when(c("__enter") & (pt == "input"), 3),
        "sig_network_idle": F.when((t == "network_idle") & (pt == "dom_settled"), 3),
        "sig_screen_changed": F.when(t == "screen_changed", 2),
        "sig_gap": F.when(gap >= gap_ms, 2),
        "sig_verb_change": F.when(c("__verb") != p("__verb"), 1),
    }
    sig = {n: F.when(has_prev, F.coalesce(e, F.lit(0))).otherwise(F.lit(0)) for n, e in sig.items()}
    reason = {
        "sig_navigate": F.lit("navigate"), "sig_url_change": F.lit("url_change"),
        "sig_focus_tab": t, "sig_form_submit": F.lit("form_submit"),
        "sig_enter_after_input": F.lit("enter_after_input"),
        "sig_network_idle": F.lit("network_idle_after_dom_settled"),
        "sig_screen_changed": F.lit("screen_changed"),
        "sig_gap": F.concat(F.lit("gap_"), gap.cast("string"), F.lit("ms")),
        "sig_verb_change": F.lit("verb_change"),
    }
    return sig, reason


def _weight(c, p, gap_ms: int):
    sig, _ = _signals(c, p, gap_ms)
    return sum(sig.values(), F.lit(0))


def _with_signal_columns(df: DataFrame, gap_ms: int) -> DataFrame:
    sig, reason = _signals(F.col, lambda n: F.col("prev_" + n), gap_ms)
    df = df.select("*", *[e.alias(n) for n, e in sig.items()])
    weight = sum((F.col(n) for n in SIGNALS), F.lit(0))
    reasons = F.filter(F.array(*[F.when(F.col(n) > 0, reason[n]) for n in SIGNALS]), lambda x: x.isNotNull())
    return df.select("*", weight.alias("weight"), reasons.alias("reasons"))


def _prep(events: DataFrame) -> DataFrame:
    """What the signals are made of; JSON values are read here, once a row."""
    t, v = F.col("type"), F.col("value_json")
    enter = (t == "key") & json_is_object(v) & (F.lower(F.coalesce(json_field(v, "key"), F.lit(""))) == "enter")
    submit = (t == "annotation") & json_is_object(v) & F.coalesce(json_field(v, "kind") == "form_submit", F.lit(False))
    return events.select("*", F.col("target.url").alias("__url"), verb_group("type").alias("__verb"),
                         enter.alias("__enter"), submit.alias("__submit"))


_OWN_COLS = ["__url", "__verb", "__enter", "__submit", *[f"prev_{c}" for c in PREV_COLS]]


def boundary_signals(events: DataFrame, gap_ms: int = model.DEFAULT_GAP_MS,
                     keys="rec_id") -> DataFrame:
    """D1..D10: ``sig_*`` weights, ``weight`` and ``reasons`` (signal order) of
    each event against its predecessor; the first event gets 0 and none."""
    df = with_adjacent(_prep(events), prev=PREV_COLS, keys=keys)
    return _with_signal_columns(df, gap_ms).drop(*_OWN_COLS)


def segment(events: DataFrame, gap_ms: int = model.DEFAULT_GAP_MS,
            threshold: int = model.DEFAULT_THRESHOLD, keys="rec_id", dealt: bool = False) -> DataFrame:
    """``seg`` = 0-based segment index, a new segment where weight >= threshold.

    In chunks, neighbours and the running cut count come from one ordered
    stage, which writes none of the signals' columns.  ``dealt``: chunked
    events lie as ``stage`` deals them, as after ``compress``."""
    if CHUNK in events.columns:
        cut = lambda c, p: (_weight(c, p, gap_ms) >= threshold).cast("long")
        df = with_prev_running(_prep(events), prev=PREV_COLS, cur=CUR_COLS, running={"seg": (cut, "sum")}, keys=keys, dealt=dealt)
        df = _with_signal_columns(df, gap_ms).drop(*_OWN_COLS)
        return df.select(*[c for c in df.columns if c != "seg"], "seg")
    df = boundary_signals(events, gap_ms=gap_ms, keys=keys)
    df = df.withColumn("__cut", (F.col("weight") >= threshold).cast("long"))
    return with_running(df, {"seg": (F.col("__cut"), "sum")}, keys=keys).drop("__cut")


# ----------------------------------------------------------------- D12 cap
def cap_survivors(sizes: list[int], cap: int) -> list[int]:
    """Indices of the segments left after merging, while more than ``cap``
    remain, the smallest segment of index >= 1 (leftmost on ties) into its left
    neighbour.  Heap + linked list, O(n log n)."""
    n = len(sizes)
    if n <= cap:
        return list(range(n))
    size = list(sizes)
    left = list(range(-1, n - 1))
    right = list(range(1, n + 1))
    alive = [True] * n
    heap = [(size[i], i) for i in range(1, n)]
    heapq.heapify(heap)
    count = n
    while count > cap:
        s, i = heapq.heappop(heap)
        if not alive[i] or s != size[i]:
            continue
        l = left[i]
        alive[i] = False
        size[l] += size[i]
        r = right[i]
        right[l] = r
        if r < n:
            left[r] = l
        if l >= 1:
            heapq.heappush(heap, (size[l], l))
        count -= 1
    return [i for i in range(n) if alive[i]]


def cap_anchors(counts: DataFrame, max_segments: int, keys_l: list[str]) -> DataFrame:
    """For recordings above the cap, ``anchors``: the segments (``keys, seg, n``) that are left after merging,
    ``max_segments`` at most.  The counts pass a task sorted, as a stream; it holds those of one recording."""
    types = {k: counts.schema[k].dataType.simpleString() for k in keys_l}

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        """Where a recording begins, as far as its batch tells."""
        new = np.zeros(batch.num_rows, bool)
        for k in keys_l:
            code = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def merge(batches):
        key, segs, sizes = None, [], []

        def done(out: list) -> None:
            if sum(map(len, segs)) > max_segments:
                seg = np.concatenate(segs)
                out.append({**dict(zip(keys_l, key)), "anchors": seg[cap_survivors(np.concatenate(sizes).tolist(), max_segments)]})

        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = pa.schema([*[batch.schema.field(k) for k in keys_l], ("anchors", pa.list_(pa.int64()))])
            seg, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("seg", "n"))
            cuts = [0, *starts(batch).tolist(), batch.num_rows]
            out = []
            for lo, hi in zip(cuts, cuts[1:]):
                now = tuple(batch.column(k)[lo].as_py() for k in keys_l)
                if now != key:
                    done(out)
                    key, segs, sizes = now, [], []
                segs.append(seg[lo:hi].astype(np.int64))
                sizes.append(n[lo:hi].astype(np.int64))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        out = []
        done(out)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    ordered = counts.select(*keys_l, "seg", "n").repartition(*keys_l).sortWithinPartitions(*keys_l, "seg")
    return ordered.mapInArrow(merge, ", ".join(f"`{k}` {t}" for k, t in types.items()) + ", anchors array<bigint>")


def capped_index() -> Column:
    """The index of a segment among its recording's anchors; without anchors, its own."""
    return F.when(F.col("anchors").isNull(), F.col("seg")).otherwise(
        F.size(F.filter("anchors", lambda a: a <= F.col("seg"))).cast("long") - 1)


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder, which goes when the driver ends: it is read more than once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cap_segments(segmented: DataFrame, max_segments: int = model.DEFAULT_MAX_SEGMENTS,
                 keys="rec_id") -> DataFrame:
    """Re-index ``seg`` after the cap merge.

    Only per-segment event counts (one row per segment, aggregated map-side)
    reach the merge, and only for recordings above the cap; the result is at
    most ``max_segments`` surviving start indices per recording, joined back on
    the event side's partitioning.  The input is read three times, so it is
    written once, in columns: the counts read two of them."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    whole = CHUNK not in segmented.columns
    if whole:
        segmented = _written(segmented, "segmented")
        per_chunk_counts = segmented.groupBy(*keys_l, "seg").agg(F.count(F.lit(1)).alias("n"))
    else:
        per_chunk_counts = segmented.groupBy(*keys_l, CHUNK, "seg").agg(F.count(F.lit(1)).alias("n"))
    anchors = cap_anchors(per_chunk_counts.groupBy(*keys_l, "seg").agg(F.sum("n").alias("n")), max_segments, keys_l)
    if whole:
        out = segmented.join(anchors, keys_l, "left")
    else:
        per_chunk = per_chunk_counts.select(*keys_l, CHUNK).distinct().join(anchors, keys_l, "inner")
        out = segmented.join(per_chunk, [*keys_l, CHUNK], "left")
    return out.withColumn("seg", capped_index()).drop("anchors")


def capped_summary(segmented: DataFrame, max_segments: int = model.DEFAULT_MAX_SEGMENTS, keys="rec_id") -> DataFrame:
    """F1 of the capped segments without going through the events again: a merged segment's summary follows from those
    of its parts.  What is written is one row a segment."""
    from clickloom.operators.summarize import combine_summaries, segment_parts
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    parts = _written(segment_parts(segmented, keys_l), "segments")
    anchors = cap_anchors(parts.select(*keys_l, "seg", F.col("event_count").alias("n")), max_segments, keys_l)
    merged = parts.join(anchors, keys_l, "left").withColumn("seg", capped_index()).drop("anchors")
    return combine_summaries(merged, keys_l)


def reject_empty(recordings: DataFrame, segmented: DataFrame, keys="rec_id") -> DataFrame:
    """Recordings without any segment (no events) -> quarantine rows."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    return (recordings.select(*keys_l).distinct()
            .join(segmented.select(*keys_l), keys_l, "left_anti")
            .withColumn("reason", F.lit("Recording has no events to translate")))
