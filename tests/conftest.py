import json
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from clickloom.session import build_session
    s = build_session("local[4]", 4, extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="clickloom-test-")})
    yield s
    s.stop()


def make_events(spark, rows, chunk_rows=1 << 20):
    """Without ``chunk_rows`` no ``_chunk`` column: plain windows.  rows: dicts with rec_id, ts_ms, type, value (python), url, screenshot_path;
    ord/id follow list order per recording."""
    from pyspark.sql import functions as F
    from clickloom.plans.ordered import add_chunk
    from clickloom import model
    seen = {}
    data = []
    for r in rows:
        rec = r.get("rec_id", 1)
        seen[rec] = seen.get(rec, 0) + 1
        o = seen[rec]
        v = r.get("value")
        data.append((rec, o, r.get("id", f"evt_{o:04d}"), r["ts_ms"], r.get("surface", "desktop"), r["type"],
                     None if v is None else json.dumps(v), r.get("url"), r.get("screenshot_path")))
    df = spark.createDataFrame(data, "rec_id bigint, ord bigint, id string, ts_ms bigint, surface string, type string, "
                                     "value_json string, url string, screenshot_path string")
    target = F.struct(F.lit(None).cast(model.SELECTORS).alias("selector_alternatives"),
                      F.array().cast("array<string>").alias("frame_path"), F.array().cast("array<string>").alias("shadow_path"),
                      F.col("url").alias("url"), F.lit(None).cast(model.VIEWPORT_BOX).alias("viewport_box"),
                      F.lit(None).cast("string").alias("accessible_name"), F.lit(None).cast("string").alias("window_title"),
                      F.lit(None).cast("string").alias("app_name"))
    df = df.select("rec_id", "ord", "id", "ts_ms", "surface", "type", "value_json", target.alias("target"),
                   "screenshot_path", F.lit(None).cast(model.VIEWPORT).alias("viewport"),
                   F.lit(False).alias("redacted"), F.lit(None).cast("string").alias("notes"))
    return df if chunk_rows is None else add_chunk(df, "ord", chunk_rows)
