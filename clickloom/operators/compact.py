"""Order-dependent event compaction (keystroke collapse, scroll coalescing).

Input: canonical events ``rec_id, ord, _chunk, id, ts_ms, surface, type,
value_json, target, screenshot_path, viewport, redacted, notes, ...``.

``compress`` is a gaps-and-islands job on the ``(rec_id, _chunk)``
partitioning: drop releases and bare modifiers, classify each row as a typed
character / scroll / other, number the runs, keep the last scroll of every
scroll run and turn every character run into one ``input`` row whose value is
the concatenated keys.  Character text is concatenated chunk-locally; only the
one run per chunk that continues into later chunks ships its later pieces
through a small aggregation, so no run is ever gathered into a single task
unless it is itself the output row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from clickloom import model
from clickloom.functions.scalars import json_field, json_has_key, json_is_object, json_quote
from clickloom.plans.ordered import CHUNK, chunk_cols, with_adjacent, with_prev_running, with_running
from clickloom.session import scratch_path

KEY = "__key"


def key_fields(df: DataFrame, value: str = "value_json") -> DataFrame:
    """Adds ``__is_key_obj``, ``__key`` (text of value.key, "" when absent),
    ``__action_ok`` (action absent or == "press")."""
    is_key_obj = (F.col("type") == "key") & json_is_object(value)
    raw_key = json_field(value, "key")
    # str(None) == "None" in the recorder's fold: a present-but-null key is the
    # four-letter string, an absent one is the empty string.
    key = (F.when(~is_key_obj, F.lit(None))
           .when(raw_key.isNotNull(), raw_key)
           .when(json_has_key(value, "key"), F.lit("None"))
           .otherwise(F.lit("")))
    action = json_field(value, "action")
    action_ok = (~json_has_key(value, "action")) | F.coalesce(action == "press", F.lit(False))
    return df.select("*", is_key_obj.alias("__is_key_obj"), key.alias(KEY),
                     action_ok.alias("__action_ok"))


def drop_releases(df: DataFrame) -> DataFrame:
    """Key presses only (absent action counts as press)."""
    return df.filter(~F.col("__is_key_obj") | F.col("__action_ok"))


def drop_modifiers(df: DataFrame) -> DataFrame:
    """Bare modifier presses are dropped (they do not break a text run)."""
    return df.filter(~F.col("__is_key_obj") | ~F.lower(F.col(KEY)).isin(*model.MODIFIER_KEYS))


def classify(df: DataFrame) -> DataFrame:
    """``__kind``: char (1-char key press), scroll, other (named keys C4,
    unknown keys and every other event type)."""
    kind = (F.when(F.col("__is_key_obj") & (F.char_length(F.col(KEY)) == 1), "char")
            .when(F.col("type") == "scroll", "scroll").otherwise("other"))
    return df.withColumn("__kind", kind)


def _run_start(c, p):
    return ((c("__kind") == "other") | p("__kind").isNull() | (p("__kind") != c("__kind"))).cast("long")


def mark_runs(df: DataFrame, keys="rec_id", dealt: bool = False) -> DataFrame:
    """Run ids: a new run at every ``other`` row and at every change of kind.
    One fused ordered stage gives the previous/next kind, the run id and the
    chunk where each run starts."""
    running = {"__run": (_run_start, "sum")}
    if CHUNK in df.columns:
        running["__run_chunk"] = (lambda c, p: F.when(_run_start(c, p) == 1, c(CHUNK)), "max")
    df = with_prev_running(df, prev=["__kind"], cur=["__kind"], nxt=["__kind"], keys=keys, running=running, dealt=dealt)
    return df.withColumn("__run_start", _run_start(F.col, lambda n: F.col("prev_" + n)).cast("int"))


def compress(events: DataFrame, keys="rec_id", dealt: bool = False) -> DataFrame:
    """C6 = C1..C5 composed.  Output keeps the input columns; character runs
    become ``type='input'`` rows with ``value_json`` = JSON string of the
    typed text, id/ts/target/screenshot/viewport of the first key and default
    ``redacted``/``notes``.  ``dealt``: chunked events lie as ``stage`` deals
    them, as after ``scrub_events``; so does the output."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    cols = list(events.columns)
    df = classify(drop_modifiers(drop_releases(key_fields(events))))
    df = mark_runs(df, keys=keys_l, dealt=dealt)

    if CHUNK not in cols:
        return _compress_whole(df, cols, keys_l)

    # other rows stay; a scroll run keeps its last row
    plain = df.filter((F.col("__kind") == "other")
                      | ((F.col("__kind") == "scroll")
                         & (F.col("next___kind").isNull() | (F.col("next___kind") != "scroll"))))
    plain = plain.select(*cols)

    # character runs (C1): chunk-local pieces, grouped on the existing partitioning.  Few rows are in a run from an
    # earlier chunk, so these are told before grouping: no piece is built twice
    chars = df.filter(F.col("__kind") == "char")
    late = F.coalesce(F.col("__run_chunk") < F.col(CHUNK), F.lit(False))
    piece = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", KEY))),
                                     lambda x: x[KEY]), "")
    # the one run per chunk that continues into later chunks: gather its tail
    tails = (chars.filter(late).groupBy(*keys_l, CHUNK, "__run", "__run_chunk").agg(piece.alias("__text"))
             .groupBy(*keys_l, "__run_chunk")
             .agg(F.first("__run").alias("__tail_run"),
                  F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(CHUNK, "__text"))),
                                           lambda x: x["__text"]), "").alias("__tail"))
             .withColumnRenamed("__run_chunk", CHUNK))
    heads = chars.filter(~late).groupBy(*keys_l, CHUNK, "__run").agg(
        F.min_by(F.struct(*cols), F.col("ord")).alias("__first"), piece.alias("__text")).join(tails, [*keys_l, CHUNK], "left")
    text = F.when(F.col("__run") == F.col("__tail_run"), F.concat("__text", "__tail")).otherwise(F.col("__text"))
    overrides = {"type": F.lit("input"), "value_json": json_quote(text),
                 "redacted": F.lit(False), "notes": F.lit(None).cast("string")}
    heads = heads.select(*[overrides[c].alias(c) if c in overrides and c in cols
                           else F.col(c) if c in keys_l + [CHUNK] else F.col("__first")[c].alias(c)
                           for c in cols])
    return plain.unionByName(heads)


def _compress_whole(df: DataFrame, cols: list[str], keys_l: list[str]) -> DataFrame:
    """The end of ``compress`` for recordings that are one window each: every run is emitted from the
    row that stands for it, a character run's first or a scroll run's last, on the windows' partitioning."""
    run = W.partitionBy(*keys_l, "__run").orderBy("ord").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    kind, char = F.col("__kind"), F.col("__kind") == "char"
    df = df.withColumn("__text", F.array_join(F.collect_list(F.when(char, F.col(KEY))).over(run), ""))
    last_scroll = (kind == "scroll") & ~F.coalesce(F.col("next___kind") == "scroll", F.lit(False))
    df = df.filter((kind == "other") | last_scroll | (char & (F.col("__run_start") == 1)))
    typed = {"type": F.lit("input"), "value_json": json_quote(F.col("__text")), "redacted": F.lit(False),
             "notes": F.lit(None).cast("string")}
    return df.select(*[F.when(char, typed[c]).otherwise(F.col(c)).alias(c) if c in typed else F.col(c) for c in cols])


# ------------------------------------------------------- live recorder side
def stop_chord(key_events: DataFrame, chord=tuple(model.DEFAULT_STOP_CHORD), keys="rec_id",
               canon: str = "canon", action: str = "action") -> DataFrame:
    """``is_stop`` marks the first press at which every chord key is held.

    Held state of key c at a row = the action of the latest press/release of
    c up to and including that row: a running max of ``(ord, action)`` over
    the chunked two-level scan (no single-task window per recording)."""
    specs = {f"__last_{c}": (F.when(F.col(canon) == c, F.struct(F.col("ord"), F.col(action))), "max")
             for c in chord}
    df = with_running(key_events, specs, keys=keys)
    held = None
    for c in chord:
        h = F.coalesce(F.col(f"__last_{c}")[action] == "press", F.lit(False))
        held = h if held is None else held & h
    df = df.withColumn("is_stop", (F.col(action) == "press") & held)
    return df.drop(*specs.keys())


def stop_points(marked: DataFrame, keys="rec_id") -> DataFrame:
    """Per recording, the ord of the stopping press (partial min aggregate)."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    return marked.filter("is_stop").groupBy(*keys_l).agg(F.min("ord").alias("stop_ord"))


def cut_at_stop(events: DataFrame, stops: DataFrame, keys="rec_id") -> DataFrame:
    """What a recorder keeps: events before the stopping press (``stop_points``), which isn't emitted itself."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    out = events.join(stops.select(*keys_l, "stop_ord"), keys_l, "left")
    return out.filter(F.col("stop_ord").isNull() | (F.col("ord") < F.col("stop_ord"))).drop("stop_ord")


def debounce(events: DataFrame, quiet_ms: int, element: list[str], keys="rec_id") -> DataFrame:
    """C8/C9 (batch): per element, an event is emitted only when no later event
    of the same element follows within ``quiet_ms``; the emission carries the
    last value and happens at ``ts + quiet_ms``."""
    keys_l = ([keys] if isinstance(keys, str) else list(keys)) + list(element)
    df = with_adjacent(events, nxt=["ts_ms"], keys=keys_l)
    keep = F.col("next_ts_ms").isNull() | ((F.col("next_ts_ms") - F.col("ts_ms")) >= quiet_ms)
    return df.filter(keep).withColumn("emit_ts_ms", F.col("ts_ms") + F.lit(quiet_ms)).drop("next_ts_ms")


#: Records of a burst that are folded as one array; longer bursts go by blocks of buckets.
FOLD = 512


def throttle(events: DataFrame, min_gap_ms: int, keys="rec_id") -> DataFrame:
    """Leading-edge throttle; keep an event when ``ts - last_kept >=
    min_gap_ms`` (last_kept starts at 0 and moves on every kept attempt).  Gives ``keys, ord, kept``.

    Order is ``ord``, and time may go back.  Only a record, an event later than all before it, can be kept: the last
    one kept is later than all before it.  An event at least ``min_gap_ms`` after the latest earlier time is kept
    whatever came before, so the records split into independent bursts.  A burst of up to ``FOLD`` records is folded
    as an array; a longer one, however long, is solved in parallel (``_throttle_long``)."""
    if min_gap_ms <= 0:
        raise ValueError("the gap must be positive")
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    slim = events.select(*keys_l, "ord", "ts_ms", *chunk_cols(events))
    slim = with_running(slim, {"__latest": (F.col("ts_ms"), "max")}, keys=keys_l)
    reset = lambda c, p: (p("__latest").isNull() | ((c("ts_ms") - p("__latest")) >= min_gap_ms)).cast("long")
    df = with_prev_running(slim, prev=["__latest"], cur=["ts_ms"], keys=keys_l, running={"__burst": (reset, "sum")})
    # nothing before min_gap_ms is kept, as last_kept is never below 0
    record = (F.col("prev___latest").isNull() | (F.col("ts_ms") > F.col("prev___latest"))) & (F.col("ts_ms") >= min_gap_ms)
    df = df.select(*keys_l, "__burst", "ord", "ts_ms", record.alias("__record"))
    never = df.filter(~F.col("__record")).select(*keys_l, "ord", F.lit(False).alias("kept"))
    records = df.filter("__record").drop("__record")
    burst = [*keys_l, "__burst"]
    long = records.groupBy(*burst).agg(F.count("*").alias("__n"), F.min("ts_ms").alias("__t0"), F.max("ts_ms").alias("__t1")).filter(F.col("__n") > FOLD)
    if long.isEmpty():
        return never.unionByName(_throttle_short(records, min_gap_ms, keys_l))
    long = long.drop("__n")
    return (never.unionByName(_throttle_short(records.join(long, burst, "left_anti"), min_gap_ms, keys_l))
            .unionByName(_throttle_long(records.join(long, burst), min_gap_ms, keys_l)))


def _throttle_short(records: DataFrame, gap: int, keys_l: list[str]) -> DataFrame:
    """Bursts as bounded arrays in order of time, which is that of ``ord`` too, folded in the JVM."""
    rows = records.groupBy(*keys_l, "__burst").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "ord"))).alias("evs"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<ord:bigint,kept:boolean>>").alias("out"))

    def step(acc, x):
        kept = acc["last"].isNull() | (x["ts_ms"] - acc["last"] >= gap)
        flag = F.struct(x["ord"].cast("long").alias("ord"), kept.alias("kept"))
        return F.struct(F.when(kept, x["ts_ms"]).otherwise(acc["last"]).cast("long").alias("last"), F.concat(acc["out"], F.array(flag)).alias("out"))

    return rows.select(*keys_l, F.inline(F.aggregate("evs", start, step)["out"]))


def _throttle_long(records: DataFrame, gap: int, keys_l: list[str]) -> DataFrame:
    """Long bursts (with their first and last time ``__t0, __t1``) by pointer doubling over buckets of ``gap`` ms.

    No bucket between a burst's ends is empty and none holds two kept records.  With t the offset that the last kept
    record has in its bucket, the next bucket keeps its first record at offset t or later; if it has none, the
    bucket after it keeps its first.  So a bucket is a function from thresholds to thresholds,
    f(t) = its least offset >= t, or 0.  Up: the functions of neighbouring blocks are composed by a join, which
    halves the number of blocks a round.  Down: the threshold at a block's beginning gives those of its halves.  All
    rounds together move about twice the records, spread over (burst, block)."""
    burst = [*keys_l, "__burst"]
    bucket = lambda c: F.expr(f"{c} div {gap}")
    records = _written(records.select(*burst, "ord", (F.col("ts_ms") % gap).alias("o"), (bucket("ts_ms") - bucket("__t0")).alias("blk"),
                                      (bucket("__t1") - bucket("__t0")).alias("last")).repartition(*burst, "blk"))
    ends = [*burst, "last"]
    # inputs of a bucket: the offsets in the one before, and 0
    asked = records.filter(F.col("blk") < F.col("last")).select(*ends, (F.col("blk") + 1).alias("blk"), "o")
    asked = asked.unionByName(records.select(*ends, "blk", F.lit(0).cast("long").alias("o"))).distinct()
    both = asked.withColumn("rec", F.lit(0)).unionByName(records.select(*ends, "blk", "o").withColumn("rec", F.lit(1)))
    # from the bucket's end backwards, its least offset so far; at most 2 * gap + 1 rows a bucket
    w = W.partitionBy(*burst, "blk").orderBy(F.desc("o"), F.desc("rec")).rowsBetween(W.unboundedPreceding, W.currentRow)
    level = both.withColumn("v", F.min(F.when(F.col("rec") == 1, F.col("o"))).over(w)).filter("rec = 0")
    level = _written(level.select(*ends, "blk", F.col("o").alias("t"), F.coalesce("v", F.lit(0)).alias("v"), F.col("v").isNotNull().alias("hit")))
    levels = [level]
    for up in range(records.agg(F.max("last")).first()[0].bit_length()):
        odd, paired = F.col("blk") % 2 == 1, F.col("blk") < F.shiftright("last", up)
        then = level.filter(odd).select(*burst, (F.col("blk") - 1).alias("blk"), F.col("t").alias("v"), F.col("v").alias("then"))
        joined = level.filter(~odd & paired).join(then, [*burst, "blk", "v"]).select(*ends, "blk", "t", F.col("then").alias("v"))
        alone = level.filter(~odd & ~paired).select(*ends, "blk", "t", "v")
        level = _written(joined.unionByName(alone).withColumn("blk", F.shiftright("blk", 1)))
        levels.append(level)
    # a burst is one block by now; its first record is kept whatever came before
    entry = _written(level.filter(F.col("t") == 0).select(*ends, "blk", "t"))
    for down in range(len(levels) - 2, -1, -1):
        left = entry.withColumn("blk", F.col("blk") * 2)
        right = (left.filter(F.col("blk") < F.shiftright("last", down)).join(levels[down].select(*burst, "blk", "t", "v"), [*burst, "blk", "t"])
                 .select(*ends, (F.col("blk") + 1).alias("blk"), F.col("v").alias("t")))
        entry = _written(left.select(*ends, "blk", "t").unionByName(right))
    hits = entry.join(levels[0].filter("hit"), [*ends, "blk", "t"]).select(*burst, "blk", F.col("v").alias("o"), F.lit(True).alias("kept"))
    return records.join(hits, [*burst, "blk", "o"], "left").select(*keys_l, "ord", F.coalesce("kept", F.lit(False)).alias("kept"))


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared scratch folder: it is read more than once."""
    path = scratch_path(df.sparkSession, "throttle")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ffill_viewport(clicks: DataFrame, w: str = "shot_w", h: str = "shot_h", keys="rec_id") -> DataFrame:
    """C11: the last non-zero screenshot size up to each click (running max of
    (ord, size) over non-zero sizes); none yet -> null viewport and path."""
    nz = (F.col(w) != 0) | (F.col(h) != 0)
    df = with_running(clicks, {"__vp": (F.when(nz, F.struct(F.col("ord"), F.col(w).alias("w"), F.col(h).alias("h"))), "max")},
                      keys=keys)
    return df.withColumn("vp_w", F.col("__vp")["w"]).withColumn("vp_h", F.col("__vp")["h"]).drop("__vp")
