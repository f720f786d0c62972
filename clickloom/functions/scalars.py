"""Column-level helpers (all JVM-side Spark SQL expressions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from clickloom import model


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def sql_str(s: str) -> str:
    """Quote a Python string as a Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


# ---------------------------------------------------------------- JSON value
def json_is_object(v: Column | str) -> Column:
    """``value_json`` holds a JSON object (dict in the recording)."""
    return F.coalesce(F.substring(F.ltrim(col_(v)), 1, 1) == F.lit("{"), F.lit(False))


def json_is_array(v: Column | str) -> Column:
    return F.coalesce(F.substring(F.ltrim(col_(v)), 1, 1) == F.lit("["), F.lit(False))


def json_is_string(v: Column | str) -> Column:
    return F.coalesce(F.substring(F.ltrim(col_(v)), 1, 1) == F.lit('"'), F.lit(False))


def json_field(v: Column | str, name: str) -> Column:
    """Top-level field of a JSON object as text (strings unquoted); null when
    absent, JSON null, or not an object."""
    return F.when(json_is_object(v), F.get_json_object(col_(v), f"$.{name}"))


def json_has_key(v: Column | str, name: str) -> Column:
    """Presence test (a key holding JSON null is present)."""
    return F.when(json_is_object(v),
                  F.array_contains(F.json_object_keys(col_(v)), F.lit(name))).otherwise(F.lit(False))


def json_quote(s: Column | str) -> Column:
    """Encode a string column as a JSON string literal (exact JSON escaping)."""
    return F.regexp_extract(F.to_json(F.array(col_(s))), r"(?s)^\[(.*)\]$", 1)


def json_text(v: Column | str) -> Column:
    """The value as text: a JSON string is unquoted, anything else stays JSON."""
    return F.get_json_object(F.concat(F.lit('{"v":'), col_(v), F.lit("}")), "$.v")


# ------------------------------------------------------------------ numbers
def js_round(x: Column | str) -> Column:
    """JavaScript ``Math.round``: halves go up (towards +inf)."""
    return F.floor(col_(x).cast("double") + F.lit(0.5)).cast("long")


def trunc_to_long(x: Column | str) -> Column:
    """Python ``int(float)``: truncation towards zero."""
    return col_(x).try_cast("double").cast("long")


def ntz_millis(ts: str) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ column, independent of the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`) div 1000")


# ------------------------------------------------------------------- keys
def canonical_key(k: Column | str) -> Column:
    """Desktop modifier aliases (``ctrl_l`` -> ``ctrl``); others unchanged."""
    m = F.create_map(*[F.lit(x) for kv in model.MOD_ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(m, col_(k)), col_(k))


def key_repr(char: Column | str, name: Column | str, raw: Column | str) -> Column:
    """char if non-empty, else name if non-empty, else raw text minus ``Key.``."""
    return F.coalesce(F.nullif(col_(char), F.lit("")), F.nullif(col_(name), F.lit("")),
                      F.replace(col_(raw), F.lit("Key."), F.lit("")))


def verb_group(t: Column | str) -> Column:
    m = F.create_map(*[F.lit(x) for kv in model.VERB_GROUPS.items() for x in kv])
    return F.coalesce(F.element_at(m, col_(t)), col_(t))


# -------------------------------------------------------------- selectors
def best_selector(sel: Column | str) -> tuple[Column, Column]:
    """(selector, which) by rank testid > role_name > text > css > xpath."""
    s = col_(sel)
    order = ["testid", "role_name", "text", "css", "xpath"]
    value = F.coalesce(*[s[o] for o in order])
    which = F.coalesce(*[F.when(s[o].isNotNull(), F.lit(o)) for o in order])
    return value, which


#: Fixed: the characters of Unicode's White_Space property.
WHITESPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def ws_trim(c: Column | str) -> Column:
    """Strip leading/trailing Unicode whitespace (JS ``trim`` / Python ``strip``)."""
    return F.btrim(col_(c), F.lit(WHITESPACE))


def accessible_name(aria: Column | str, placeholder: Column | str, text: Column | str,
                    is_input: Column | None = None) -> Column:
    """First non-empty of aria-label, (input) placeholder, text content; trimmed,
    at most 200 characters; null when none."""
    ph = col_(placeholder) if is_input is None else F.when(is_input, col_(placeholder))
    a = F.nullif(col_(aria), F.lit(""))
    p = F.nullif(ph, F.lit(""))
    t = F.nullif(ws_trim(col_(text)), F.lit(""))
    return (F.when(a.isNotNull(), F.substring(ws_trim(a), 1, 200))
             .when(p.isNotNull(), F.substring(ws_trim(p), 1, 200))
             .when(t.isNotNull(), F.substring(t, 1, 200)))


# ---------------------------------------------------------------- entropy
#: A character that comes again at once, and its repeats.
RUN = r"(?s)(.)\1++"


def shannon_entropy(s: Column | str) -> Column:
    """-sum p log2 p over the characters of ``s`` (0.0 for the empty string).

    The sorted characters, joined again, fall into runs of equal ones, found by
    one pattern: their lengths are the counts c, and H = log2(n) - sum(c log2 c) / n."""
    n = F.char_length(col_(s)).cast("double")
    ordered = F.array_join(F.sort_array(F.split(col_(s), "")), "")
    repeated = F.regexp_extract_all(ordered, F.lit(RUN), 0)  # a run of one adds nothing
    acc = F.aggregate(repeated, F.lit(0.0), lambda a, r: bound(F.char_length(r).cast("double"), lambda c: a + c * F.log2(c)))
    return F.when(F.length(col_(s)) == 0, F.lit(0.0)).otherwise(F.log2(n) - acc / n)


def looks_like_secret(s: Column | str) -> Column:
    """No inner space after trimming; has a letter and a digit."""
    c = col_(s)
    stripped = ws_trim(c)
    return (~stripped.contains(" ")) & c.rlike(r"\p{L}") & c.rlike(r"\p{Nd}")
