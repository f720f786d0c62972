"""Segment summaries and the model payload (data part only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickloom import model


def segment_summary(segmented: DataFrame, keys="rec_id") -> DataFrame:
    """per (recording, seg): duration = last.ts - first.ts by order,
    event_count, boundary screenshot = last non-empty screenshot path.
    All aggregates are partial (map-side) so a huge segment is combined
    before the shuffle."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    path = F.col("screenshot_path")
    return segmented.groupBy(*keys_l, "seg").agg(
        (F.max_by("ts_ms", "ord") - F.min_by("ts_ms", "ord")).alias("duration_ms"),
        F.count(F.lit(1)).alias("event_count"),
        F.max_by(path, F.when(path.isNotNull() & (path != ""), F.col("ord"))).alias("boundary_screenshot"),
        F.min("ord").alias("first_ord"),
        F.max("ord").alias("last_ord"),
    )


def segment_parts(segmented: DataFrame, keys_l: list[str]) -> DataFrame:
    """What the summaries of segments and of their mergers follow from, by partial aggregates."""
    path = F.col("screenshot_path")
    shot = F.when(path.isNotNull() & (path != ""), F.struct("ord", path.alias("path")))
    return segmented.groupBy(*keys_l, "seg").agg(
        F.min(F.struct("ord", "ts_ms")).alias("first"), F.max(F.struct("ord", "ts_ms")).alias("last"),
        F.count(F.lit(1)).alias("event_count"), F.max(shot).alias("shot"))


def combine_summaries(parts: DataFrame, keys_l: list[str]) -> DataFrame:
    """F1 from ``segment_parts`` whose ``seg`` may have been merged."""
    return parts.groupBy(*keys_l, "seg").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("event_count").alias("event_count"), F.max("shot").alias("shot")).select(
        *keys_l, "seg", (F.col("last.ts_ms") - F.col("first.ts_ms")).alias("duration_ms"), "event_count", F.col("shot.path").alias("boundary_screenshot"),
        F.col("first.ord").alias("first_ord"), F.col("last.ord").alias("last_ord"))


def event_projection(events: DataFrame) -> DataFrame:
    """the per-event fields sent with a segment."""
    t = F.col("target")
    return events.select(
        *[c for c in events.columns if c in ("rec_id", "seg", "ord")],
        "id", "type", F.col("value_json").alias("value"),
        t["url"].alias("target_url"),
        t["selector_alternatives"]["text"].alias("target_text"),
        t["selector_alternatives"]["role_name"].alias("target_role"),
        t["accessible_name"].alias("accessible_name"),
        "screenshot_path",
    )


def notes_table(notes: DataFrame) -> DataFrame:
    """Timestamped free-text notes kept beside the events, one row per
    note keyed (rec_id, ord); ordering by ts happens where they are consumed."""
    return notes.select("rec_id", "ord", F.col("ts_ms").cast("long").alias("ts_ms"), "text")
