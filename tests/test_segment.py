import random

from conftest import make_events

from clickloom.operators.compact import compress
from clickloom.operators.segment import boundary_signals, cap_segments, cap_survivors, segment
from clickloom.operators.summarize import segment_summary

T0 = 1_000_000


def _scored(spark, *events):
    df = boundary_signals(make_events(spark, list(events)), gap_ms=1500)
    return [(r["weight"], list(r["reasons"])) for r in df.orderBy("ord").collect()]


def _ev(ts, type, url="page:one", **more):
    return {"ts_ms": T0 + ts, "type": type, "url": url, **more}


def test_signals_add_up(spark):
    got = _scored(spark,
                  _ev(0, "hover"),
                  _ev(40, "drag"),                                   # another verb
                  _ev(80, "drop", url="page:two"),                   # same verb, other page
                  _ev(1580, "navigate", url="page:three"),           # exactly the gap; navigation hides the page change
                  _ev(1600, "screen_changed", url=None),
                  _ev(1700, "tab_open", url=None),
                  _ev(1700, "annotation", url=None, value={"kind": "form_submit"}),
                  _ev(1701, "annotation", url=None, value="form_submit"))
    assert got == [
        (0, []), (1, ["verb_change"]), (3, ["url_change"]), (6, ["navigate", "gap_1500ms", "verb_change"]),
        (3, ["screen_changed", "verb_change"]), (4, ["tab_open", "verb_change"]), (4, ["form_submit", "verb_change"]), (0, [])]


def test_signals_that_need_the_event_before(spark):
    got = _scored(spark,
                  _ev(0, "dom_settled"), _ev(10, "network_idle"),
                  _ev(20, "network_idle"),                            # not after dom_settled
                  _ev(30, "input", value="query"), _ev(60, "key", value={"key": "ENTER"}),
                  _ev(90, "key", value={"key": "enter"}))             # after a key
    assert [w for w, _ in got] == [0, 4, 0, 1, 3, 0]
    assert got[1][1][0] == "network_idle_after_dom_settled" and got[4][1] == ["enter_after_input"]


def _segments(spark, rows, chunk_rows=1 << 20, cap=None):
    seg = segment(compress(make_events(spark, rows, chunk_rows)), gap_ms=1500)
    if cap is not None:
        seg = cap_segments(seg, cap)
    return seg


# A shop visit: search by keyboard, look at two results, pay.
VISIT = [
    _ev(0, "navigate", url="shop/"),
    _ev(300, "click", url="shop/", screenshot_path="s/search.png"),
    _ev(500, "key", url="shop/", value={"key": "t"}), _ev(620, "key", url="shop/", value={"key": "e"}),
    _ev(700, "key", url="shop/", value={"key": "a"}),
    _ev(900, "key", url="shop/", value={"key": "Enter"}, screenshot_path="s/enter.png"),
    _ev(1200, "scroll", url="shop/", value={"dy": 10}), _ev(1300, "scroll", url="shop/", value={"dy": 25}),
    _ev(3000, "click", url="shop/", screenshot_path="s/first.png"),
    _ev(3400, "click", url="shop/item?7"),
    _ev(3500, "hover", url="shop/item?7"),
    _ev(9000, "file_upload", url="shop/item?7"),
]
# typed "tea" is one input at 500; the scrolls one at 1300.  Cuts: Enter after the input (3); the click at 3000 (gap 1700
# and another verb: 3); the page change at 3400 (3).  The late upload has a gap alone (2), the scroll a verb alone (1).
VISIT_SEGMENTS = [0, 0, 0, 1, 1, 2, 3, 3, 3]


def test_visit_by_hand(spark):
    for chunk in (1, 2, 3, 1 << 20):
        seg = _segments(spark, VISIT, chunk, cap=25)
        assert [r["seg"] for r in seg.orderBy("ord").collect()] == VISIT_SEGMENTS
        s = segment_summary(seg).orderBy("seg").collect()
        assert [r["duration_ms"] for r in s] == [500, 400, 0, 5600]
        assert [r["event_count"] for r in s] == [3, 2, 1, 3]
        assert [r["boundary_screenshot"] for r in s] == ["s/search.png", "s/enter.png", "s/first.png", None]


def test_cap_merges_the_smallest_to_its_left(spark):
    seg = _segments(spark, VISIT, cap=3)  # sizes 3 2 1 3: the single click joins the Enter
    assert [r["seg"] for r in seg.orderBy("ord").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2]


def cap_fold(sizes, cap):
    idx = [[i] for i in range(len(sizes))]
    while len(idx) > cap:
        k = min(range(1, len(idx)), key=lambda i: sum(sizes[j] for j in idx[i]))
        idx[k - 1].extend(idx[k])
        del idx[k]
    return [g[0] for g in idx]


def test_cap_survivors_match_fold():
    rnd = random.Random(3)
    for _ in range(300):
        sizes = [rnd.randint(1, 6) for _ in range(rnd.randint(1, 40))]
        for cap in (1, 3, 5, 8, 25):
            assert cap_survivors(sizes, cap) == cap_fold(sizes, cap), (sizes, cap)


def test_segment_random_chunks_agree(spark):
    rnd = random.Random(11)
    rows = []
    for rec in range(1, 4):
        t = 0
        for i in range(rnd.randint(20, 70)):
            t += rnd.choice([100, 400, 2000, 5000])
            rows.append({"rec_id": rec, "ts_ms": t, "type": rnd.choice(["click", "navigate", "input", "scroll", "key", "tab_switch"]),
                         "value": {"key": rnd.choice(["a", "enter"])}, "url": rnd.choice(["u1", "u2"])})
    ref = [(r["rec_id"], r["ord"], r["seg"]) for r in _segments(spark, rows, 1 << 20, cap=5).orderBy("rec_id", "ord").collect()]
    for chunk in (2, 5):
        got = [(r["rec_id"], r["ord"], r["seg"]) for r in _segments(spark, rows, chunk, cap=5).orderBy("rec_id", "ord").collect()]
        assert got == ref
