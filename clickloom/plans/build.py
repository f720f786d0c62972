"""The build flow (F13): scrub -> compress -> segment -> cap -> summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickloom import model
from clickloom.operators.compact import compress
from clickloom.operators.segment import cap_segments, capped_summary, segment
from clickloom.operators.summarize import segment_summary
from clickloom.plans.ordered import chunk_cols


def segmented_events(events: DataFrame, gap_ms: int = model.DEFAULT_GAP_MS,
                     threshold: int = model.DEFAULT_THRESHOLD,
                     max_segments: int | None = model.DEFAULT_MAX_SEGMENTS,
                     scrub: bool = True, keys="rec_id") -> DataFrame:
    """Events after scrub, compress, segment and (optionally) the cap."""
    if scrub:
        from clickloom.operators.redact import scrub_events
        events = scrub_events(events, keys=keys)
    seg = segment(compress(events, keys=keys, dealt=scrub), gap_ms=gap_ms, threshold=threshold, keys=keys, dealt=True)
    if max_segments is not None:
        seg = cap_segments(seg, max_segments=max_segments, keys=keys)
    return seg


def build_summaries(events: DataFrame, gap_ms: int = model.DEFAULT_GAP_MS,
                    threshold: int = model.DEFAULT_THRESHOLD,
                    max_segments: int | None = model.DEFAULT_MAX_SEGMENTS,
                    scrub: bool = True, keys="rec_id") -> DataFrame:
    """One row per (recording, segment) of the capped segmentation.  Columns that no step reads go first, as steps
    write and regroup events whole."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    target = F.struct(F.col("target.url").alias("url")).alias("target")
    events = events.select(*keys_l, *chunk_cols(events), "ord", "ts_ms", "type", "value_json", target, "screenshot_path")
    seg = segmented_events(events, gap_ms, threshold, None, scrub, keys)
    return segment_summary(seg, keys=keys) if max_segments is None else capped_summary(seg, max_segments, keys)
