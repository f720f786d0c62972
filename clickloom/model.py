"""Data model: Spark schemas for recordings and the fixed values the
operators must share with the original recorder/translator behaviour."""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Fixed values (must stay equal to the behaviour being reproduced).
# --------------------------------------------------------------------------
SCHEMA_VERSION = "1.0"

EVENT_TYPES = [
    "click", "key", "input", "navigate", "scroll", "screenshot", "annotation",
    "wait", "drag", "drop", "file_upload", "clipboard", "focus_change",
    "tab_open", "tab_close", "tab_switch", "hover", "dom_settled",
    "network_idle", "screen_changed",
]
SURFACES = ["browser", "desktop"]
CONFIDENCE_LEVELS = ["high", "medium", "low"]

# compression
MODIFIER_KEYS = ["shift", "ctrl", "alt", "cmd", "meta"]
NAMED_KEYS = ["enter", "tab", "backspace", "esc", "escape", "delete", "up",
              "down", "left", "right", "home", "end", "page_up", "page_down"]

# segmentation
DEFAULT_THRESHOLD = 3
DEFAULT_GAP_MS = 1500
DEFAULT_MAX_SEGMENTS = 25
FOCUS_TAB_TYPES = ["focus_change", "tab_open", "tab_close", "tab_switch"]
VERB_GROUPS = {
    "click": "click", "input": "type", "key": "type", "scroll": "scroll",
    "navigate": "navigate", "drag": "drag", "drop": "drag",
    "file_upload": "click", "annotation": "annotation", "hover": "click",
    "focus_change": "navigate", "tab_switch": "navigate",
}

# redaction: (kind, pattern) applied in this order, each on the previous output
REDACTION_PATTERNS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("AWS_KEY", r"\bAKIA[0-9A-Z]{16}\b"),
    ("GITHUB_PAT", r"\bghp_[A-Za-z0-9]{36}\b"),
    ("STRIPE_KEY", r"\bsk_(?:live|test)_[A-Za-z0-9]{16,}\b"),
    ("ANTHROPIC_KEY", r"\bsk-ant-[A-Za-z0-9_\-]{32,}\b"),
    ("BEARER_TOKEN", r"\bBearer\s+[A-Za-z0-9._\-]{20,}\b"),
    ("JWT", r"\beyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\b"),
    ("PHONE", r"\+?\d{1,3}[\s.\-]?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
]
HIGH_ENTROPY_KIND = "HIGH_ENTROPY"
HIGH_ENTROPY_THRESHOLD = 3.5
HIGH_ENTROPY_MIN_LEN = 24

# payload admission
ALLOWED_ORIGIN_PREFIXES = ["chrome-extension://", "moz-extension://"]
MAX_BODY_BYTES = 256 * 1024 * 1024
UPLOAD_PATH = "/recordings"

# recorder-side rate limits and caps
INPUT_DEBOUNCE_MS = 250
SCROLL_DEBOUNCE_MS = 200
SCREENSHOT_THROTTLE_MS = 250
MAX_SCREENSHOTS = 8
VISUAL_EVENT_TYPES = ["click", "navigate", "file_upload"]
BROWSER_NAMED_KEYS = ["Enter", "Tab", "Escape", "ArrowUp", "ArrowDown",
                      "ArrowLeft", "ArrowRight", "Backspace", "Delete"]
SECRET_LABEL_PATTERN = r"password|secret|token|api[ _-]?key|credit[ _-]?card"
DEFAULT_STOP_CHORD = ["ctrl", "shift", "esc"]
MOD_ALIASES = {
    "ctrl_l": "ctrl", "ctrl_r": "ctrl", "shift_l": "shift", "shift_r": "shift",
    "alt_l": "alt", "alt_r": "alt", "alt_gr": "alt", "cmd_l": "cmd",
    "cmd_r": "cmd", "cmd": "cmd",
}

# document lint
NAME_PATTERN = r"[a-z0-9][a-z0-9-]{0,62}[a-z0-9]"
MAX_DESCRIPTION_CHARS = 1024
DRAFT_REQUIRED_KEYS = ["name", "description", "title", "when_to_use",
                       "prerequisites", "inputs", "high_level_approach", "steps",
                       "success_criteria", "failure_modes"]
STEP_REQUIRED_KEYS = ["index", "title", "goal", "action", "expected_result",
                      "fallback", "screenshot_path", "source_event_ids"]
LABEL_REQUIRED_KEYS = ["intent", "target_description", "expected_outcome", "confidence"]

# --------------------------------------------------------------------------
# Spark schemas
# --------------------------------------------------------------------------
SELECTORS = T.StructType([T.StructField(n, T.StringType()) for n in
                          ["css", "xpath", "aria", "text", "testid", "role_name"]])
VIEWPORT_BOX = T.StructType([T.StructField(n, T.LongType()) for n in ["x", "y", "w", "h"]])
VIEWPORT = T.StructType([
    T.StructField("w", T.LongType()), T.StructField("h", T.LongType()),
    T.StructField("dpr", T.DoubleType()), T.StructField("zoom", T.DoubleType()),
])
TARGET = T.StructType([
    T.StructField("selector_alternatives", SELECTORS),
    T.StructField("frame_path", T.ArrayType(T.StringType())),
    T.StructField("shadow_path", T.ArrayType(T.StringType())),
    T.StructField("url", T.StringType()),
    T.StructField("viewport_box", VIEWPORT_BOX),
    T.StructField("accessible_name", T.StringType()),
    T.StructField("window_title", T.StringType()),
    T.StructField("app_name", T.StringType()),
])
# ``value`` is free-form in recordings; we keep it as its JSON text.
RAW_EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("ts_ms", T.DoubleType()),
    T.StructField("surface", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("target", TARGET),
    T.StructField("value", T.StringType()),
    T.StructField("screenshot_path", T.StringType()),
    T.StructField("viewport", VIEWPORT),
    T.StructField("redacted", T.BooleanType()),
    T.StructField("notes", T.StringType()),
])
METADATA = T.StructType([
    T.StructField("os", T.StringType()), T.StructField("browser", T.StringType()),
    T.StructField("viewport", VIEWPORT), T.StructField("user_intent_hint", T.StringType()),
])
NOTE = T.StructType([T.StructField("ts_ms", T.LongType()), T.StructField("text", T.StringType())])
RECORDING = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("surface", T.StringType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("ended_at", T.StringType()),
    T.StructField("metadata", METADATA),
    T.StructField("events", T.ArrayType(RAW_EVENT)),
    T.StructField("notes", T.ArrayType(NOTE)),
])

STEP = T.StructType([
    T.StructField("index", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("goal", T.StringType()), T.StructField("action", T.StringType()),
    T.StructField("expected_result", T.StringType()), T.StructField("fallback", T.StringType()),
    T.StructField("screenshot_path", T.StringType()),
    T.StructField("source_event_ids", T.ArrayType(T.StringType())),
])
DRAFT = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("when_to_use", T.ArrayType(T.StringType())),
    T.StructField("prerequisites", T.ArrayType(T.StringType())),
    T.StructField("inputs", T.ArrayType(T.StringType())),
    T.StructField("high_level_approach", T.StringType()),
    T.StructField("steps", T.ArrayType(STEP)),
    T.StructField("success_criteria", T.ArrayType(T.StringType())),
    T.StructField("failure_modes", T.ArrayType(T.StringType())),
])
LABEL = T.StructType([
    T.StructField("intent", T.StringType()),
    T.StructField("target_description", T.StringType()),
    T.StructField("expected_outcome", T.StringType()),
    T.StructField("confidence", T.StringType()),
])


# --------------------------------------------------------------------------
# The same as JSON may hold it: shapes with rules (functions/shapes.py).
# --------------------------------------------------------------------------
def ruled(name: str, kind: T.DataType, **rules) -> T.StructField:
    """A field with rules: required, null (allowed), enum, closed, fraction."""
    return T.StructField(name, kind, True, rules)


def _texts(*names: str) -> list[T.StructField]:
    return [ruled(n, T.StringType(), null=True) for n in names]


def _needed(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [ruled(n, kind, required=True) for n in names]


_LIST = T.ArrayType(T.StringType())
VIEWPORT_SHAPE = T.StructType([*_needed(T.LongType(), "w", "h"), ruled("dpr", T.DoubleType()), ruled("zoom", T.DoubleType())])
TARGET_SHAPE = T.StructType([
    ruled("selector_alternatives", T.StructType(_texts(*SELECTORS.names))), ruled("frame_path", _LIST), ruled("shadow_path", _LIST),
    *_texts("url"), ruled("viewport_box", T.StructType(_needed(T.LongType(), *VIEWPORT_BOX.names)), null=True),
    *_texts("accessible_name", "window_title", "app_name")])


def _event_shape(*first: T.StructField) -> T.StructType:
    return T.StructType([
        *first, ruled("type", T.StringType(), required=True, enum=EVENT_TYPES), ruled("target", TARGET_SHAPE), ruled("value", T.VariantType(), null=True),
        *_texts("screenshot_path"), ruled("viewport", VIEWPORT_SHAPE, null=True), ruled("redacted", T.BooleanType()), *_texts("notes")])


def _recording_shape(surfaces: list[str], event: T.StructType) -> T.StructType:
    metadata = T.StructType([*_texts("os", "browser"), ruled("viewport", VIEWPORT_SHAPE, null=True), *_texts("user_intent_hint")])
    note = T.StructType([*_needed(T.LongType(), "ts_ms"), *_needed(T.StringType(), "text")])
    return T.StructType([
        ruled("version", T.StringType()), ruled("surface", T.StringType(), required=True, enum=surfaces),
        *_needed(T.TimestampType(), "started_at", "ended_at"), ruled("metadata", metadata),
        ruled("events", T.ArrayType(event)), ruled("notes", T.ArrayType(note))])


#: A stored recording, and an upload: its events get new ids, may lack a surface and have fractions of milliseconds.
RECORDING_SHAPE = _recording_shape(SURFACES, _event_shape(
    ruled("id", T.StringType(), required=True), ruled("ts_ms", T.LongType(), required=True), ruled("surface", T.StringType(), required=True, enum=SURFACES)))
UPLOAD_SHAPE = _recording_shape(["browser"], _event_shape(
    ruled("ts_ms", T.LongType(), required=True, fraction=True), ruled("surface", T.StringType(), enum=SURFACES)))
STEP_SHAPE = T.StructType([*_needed(T.LongType(), "index"), *_needed(T.StringType(), "title", "goal", "action", "expected_result"),
                           *_texts("fallback", "screenshot_path"), ruled("source_event_ids", _LIST)])
DRAFT_SHAPE = T.StructType([
    *_needed(T.StringType(), "name", "description", "title"), *[ruled(n, _LIST) for n in ("when_to_use", "prerequisites", "inputs")],
    *_needed(T.StringType(), "high_level_approach"), ruled("steps", T.ArrayType(STEP_SHAPE), required=True),
    *[ruled(n, _LIST) for n in ("success_criteria", "failure_modes")]])
