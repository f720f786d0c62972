"""Redaction of secrets and personal data with numbered placeholders.

Three phases, all Spark expressions:

1. per string leaf, for each pattern in order: record the matches, replace
   them with a private-use sentinel (one per kind) so that later patterns see
   the same boundaries as after a placeholder; then the high-entropy rule;
2. per recording and kind, the number of earlier matches (exclusive running
   sum over (ord, leaf)) with the chunked two-level prefix sum;
3. per leaf, split on each sentinel and rejoin with ``<KIND_n>``.

A pattern is tried only on texts that hold what all of its matches hold
(``NEEDS``), and what a step of a chain names twice is bound to a lambda
variable: written as columns on columns, a filter that is pushed down would
spell the chain out with two copies of the steps before at every step.  Sentinel characters in the input
are escaped before phase 1 and restored after phase 3.

Known divergence: a later pattern can match the digits inside a placeholder
only once a counter reaches 11 digits; sentinels never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clickloom import model
from clickloom.functions.scalars import bound, json_is_array, json_is_object, json_is_string, json_quote, json_text
from clickloom.functions.scalars import looks_like_secret, shannon_entropy
from clickloom.plans.ordered import chunk_cols, stage, with_running

KINDS = [k for k, _ in model.REDACTION_PATTERNS] + [model.HIGH_ENTROPY_KIND]
SENTINELS = [chr(0xE000 + i) for i in range(len(KINDS))]
ESCAPE = chr(0xE0F0)
# what stands for the escape and the sentinels where the input has them
ESCAPED = [(ESCAPE, ESCAPE + chr(0xE0F1))] + [(x, ESCAPE + chr(0xE0F2 + i)) for i, x in enumerate(SENTINELS)]
_OWN = f"[{SENTINELS[0]}-{SENTINELS[-1]}{ESCAPE}]"
#: What every match of a pattern holds: a literal, and for the last two four digits in a row.
NEEDS = {"EMAIL": "@", "AWS_KEY": "AKIA", "GITHUB_PAT": "ghp_", "STRIPE_KEY": "sk_", "ANTHROPIC_KEY": "sk-ant-",
         "BEARER_TOKEN": "Bearer", "JWT": "eyJ", "PHONE": "", "SSN": "-"}
FOUR_DIGITS = r"(?U)\d{4}"


def java_pattern(pat: str) -> str:
    """Python ``re`` classes are Unicode-aware; Java needs ``(?U)``."""
    return "(?U)" + pat


def _n(i: int) -> str:
    return f"n_{KINDS[i]}"


def _escape(text: Column) -> Column:
    out = text
    for x, y in ESCAPED:
        out = F.replace(out, F.lit(x), F.lit(y))
    return F.when(text.rlike(_OWN), out).otherwise(text)


def _restore(text: Column) -> Column:
    out = text
    for x, y in reversed(ESCAPED):
        out = F.replace(out, F.lit(y), F.lit(x))
    return F.when(text.contains(ESCAPE), out).otherwise(text)


def _matches(kind: str, pat: str, text: Column) -> Column:
    """Lengths (code points) of the matches; null if there are none."""
    may = text.contains(NEEDS[kind]) if NEEDS[kind] else F.lit(True)
    if kind in ("PHONE", "SSN"):
        may = may & text.rlike(FOUR_DIGITS)
    found = F.transform(F.regexp_extract_all(text, F.lit(java_pattern(pat)), 0), lambda m: F.char_length(m))
    return F.when(may, bound(found, lambda x: F.when(F.size(x) > 0, x)))


def _chain(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Struct of the sentinelised text ``t`` and, per pattern, the match lengths ``len_<KIND>`` (null: none).  Each step's
    input is an argument, not a lambda around it: Spark prepares lambdas in lambdas in time exponential in their depth."""
    def step(state: Column, i: int) -> Column:
        kind, pat = patterns[i]
        return bound(state, lambda s: bound(_matches(kind, pat, s["t"]), lambda x: F.struct(
            F.when(x.isNotNull(), F.regexp_replace(s["t"], java_pattern(pat), SENTINELS[i])).otherwise(s["t"]).alias("t"),
            *[s[f"len_{k}"].alias(f"len_{k}") for k, _ in patterns[:i]], x.alias(f"len_{kind}"))))

    state = F.struct(_escape(text).alias("t"))
    for i in range(len(patterns)):
        state = step(state, i)
    return state


def detect(df: DataFrame, text: str = "text", out: str = "__t", until: str | None = None) -> DataFrame:
    """Phase 1: adds ``__t`` (sentinelised text), ``n_<KIND>`` match counts and
    ``len_<KIND>`` arrays of match lengths (code points).  With ``until`` the
    chain ends after that pattern, which no later one has a part in."""
    kinds = KINDS if until is None else KINDS[:KINDS.index(until) + 1]
    patterns = [(k, p) for k, p in model.REDACTION_PATTERNS if k in kinds]
    # the partition's number makes Spark evaluate the chain once a row and where it stands: filters on what it finds
    # stay above it, and so behind the exchange that deals the texts out
    once = F.when(F.spark_partition_id() >= 0, F.col(text))
    df = df.withColumn("__found", _chain(once, patterns))
    f, nothing = F.col("__found"), F.array().cast("array<int>")
    lens = {k: f[f"len_{k}"] for k, _ in patterns}
    if model.HIGH_ENTROPY_KIND in kinds:
        hit = F.coalesce(*lens.values()).isNotNull()
        t = F.col(text)  # a replaced match would leave a placeholder, and with it a "<"
        he = (~hit & F.coalesce(F.char_length(t) >= model.HIGH_ENTROPY_MIN_LEN, F.lit(False))
              & ~t.contains("<") & looks_like_secret(t) & (shannon_entropy(t) >= model.HIGH_ENTROPY_THRESHOLD))
        lens[model.HIGH_ENTROPY_KIND] = F.when(he, F.array(F.char_length(t)))
    df = df.select("*", f["t"].alias(out), *[F.coalesce(x, nothing).alias(f"len_{k}") for k, x in lens.items()]).drop("__found")
    return df.select("*", *[F.size(f"len_{k}").cast("long").alias(f"n_{k}") for k in kinds])


def number(df: DataFrame, keys="rec_id", ord=("ord", "leaf")) -> DataFrame:
    """Phase 2: ``off_<KIND>`` = matches of that kind in earlier leaves of the
    same recording."""
    specs = {f"off_{k}": (F.col(f"n_{k}"), "sum") for k in KINDS}
    return with_running(df, specs, keys=keys, ord=list(ord), inclusive=False)


def rebuild(df: DataFrame, t: str = "__t", out: str = "scrubbed") -> DataFrame:
    """Phase 3: replace the j-th sentinel of kind i by ``<KIND_{off+j}>``."""
    def numbered(text: Column, kind: str, sentinel: str) -> Column:
        off = F.col(f"off_{kind}")
        return bound(text, lambda x: F.when(F.col(f"n_{kind}") > 0, F.array_join(F.transform(
            F.split(x, sentinel, -1), lambda p, j: F.when(j == 0, p).otherwise(
                F.concat(F.lit(f"<{kind}_"), (off + j).cast("string"), F.lit(">"), p))), "")).otherwise(x))

    he = model.HIGH_ENTROPY_KIND
    some = F.greatest(*[F.col(f"n_{k}") for k in KINDS[:-1]]) > 0
    text = F.col(t)
    for kind, sentinel in zip(KINDS[:-1], SENTINELS):
        text = numbered(text, kind, sentinel)
    return df.withColumn(out, F.when(F.col(f"n_{he}") > 0, F.concat(F.lit(f"<{he}_"), (F.col(f"off_{he}") + 1).cast("string"), F.lit(">")))
                         .when(some, bound(text, _restore)).otherwise(_restore(F.col(t))))


def scrub_leaves(leaves: DataFrame, text: str = "text", keys="rec_id", ord=("ord", "leaf")) -> DataFrame:
    """E1-E11 on a table of string leaves ``(keys, ord..., _chunk, text)``."""
    return rebuild(number(detect(leaves, text), keys=keys, ord=ord))


def redaction_log(scrubbed: DataFrame, keys="rec_id", event_id: str = "id") -> DataFrame:
    """One row per replacement with its placeholder and original length.
    Sort key: (ord, leaf, kind index, position)."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    per_kind = F.array(*[F.struct(F.lit(i).alias("kind_idx"), F.lit(k).alias("kind"),
                                  F.col(f"off_{k}").alias("off"), F.col(f"len_{k}").alias("lens"))
                         for i, k in enumerate(KINDS)])
    x = scrubbed.select(*keys_l, "ord", "leaf", F.col(event_id).alias("event_id"),
                        F.explode(F.filter(per_kind, lambda s: F.size(s["lens"]) > 0)).alias("k"))
    x = x.select(*keys_l, "ord", "leaf", "event_id", "k.kind_idx", "k.kind", "k.off",
                 F.posexplode("k.lens").alias("pos", "original_length"))
    return x.select(*keys_l, "ord", "leaf", "kind_idx", "pos", "event_id",
                    F.concat(F.lit("<"), F.col("kind"), F.lit("_"), (F.col("off") + F.col("pos") + 1).cast("string"),
                             F.lit(">")).alias("placeholder"),
                    "kind", F.col("original_length").cast("long").alias("original_length"))


def redaction_counts(log: DataFrame, keys="rec_id") -> DataFrame:
    """Per recording and kind, number of replacements (partial aggregation)."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    return log.groupBy(*keys_l, "kind").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------- event values
#: A string literal of valid JSON, with the colon behind it if it is a key.  The possessive groups are loops, not
#: recursion, so literals may be of any length.
LITERAL = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?+'


def json_literals(v: Column) -> Column:
    """The string literals of valid JSON in document order, keys (with their colons) too: nothing but a literal holds quotes."""
    return F.regexp_extract_all(v, F.lit(LITERAL), 0)


def json_string_leaves(v: Column) -> Column:
    """Its string leaves (dict values, list items, the value itself; no keys) as ``leaf``, the literal's number, and ``text``."""
    numbered = F.transform(json_literals(v), lambda x, i: F.struct(i.alias("leaf"), x.alias("x")))
    leaves = F.filter(numbered, lambda s: s["x"].endswith('"'))
    return F.transform(leaves, lambda s: F.struct(s["leaf"].alias("leaf"), json_text(s["x"]).alias("text")))


def json_replace_leaves(v: Column, new: Column) -> Column:
    """Put literals (``new``: map of a leaf to its JSON) back into a JSON value; all other characters stay as they are."""
    old = json_literals(v)
    gaps = F.split(v, LITERAL, -1)
    return F.array_join(F.transform(gaps, lambda g, i: F.when(i == 0, g).otherwise(
        F.concat(F.coalesce(F.try_element_at(new, i - 1), F.get(old, i - 1)), g))), "")


def _may_change(v: Column) -> Column:
    """False only where no string leaf of a JSON text can hold a secret: without a backslash, leaves stand in it as they
    are, so it holds what a match needs, or a digit and as many characters between quotes as a high-entropy leaf has."""
    some = v.contains("\\") | v.rlike(FOUR_DIGITS)
    for need in NEEDS.values():
        if need and need != NEEDS["SSN"]:  # a PHONE or SSN has four digits in a row
            some = some | v.contains(need)
    long = v.rlike(r"\p{Nd}") & v.rlike(f'[^"]{{{model.HIGH_ENTROPY_MIN_LEN}}}')
    return F.coalesce(some | long, F.lit(False))


def scrub_events(events: DataFrame, keys="rec_id", value: str = "value_json") -> DataFrame:
    """Scrub the string leaves of ``value_json`` of every event, at any depth; ``redacted`` |= changed.
    What isn't replaced stays character by character: numbers, key order, spacing, escapes.  Malformed JSON has no
    leaves and stays.

    Events in chunks are staged as they are; only those whose value may change become leaves, are numbered and
    regrouped, which carries every event whole through a second stage."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    if not chunk_cols(events):
        return _scrub_all(events, keys_l, value)
    events = stage(events, keys_l)
    may = _may_change(F.col(value))
    # one row per (recording, ord), as regrouping gives: if it repeats, the event that may change stands for it
    same = W.partitionBy(*keys_l, *chunk_cols(events), "ord").orderBy(F.desc("__may"))
    rest = events.withColumn("__may", may).select("*", F.row_number().over(same).alias("__n")).filter(~F.col("__may") & (F.col("__n") == 1))
    if "redacted" in events.columns:
        rest = rest.withColumn("redacted", F.coalesce("redacted", F.lit(False)))
    return rest.select(*events.columns).unionByName(_scrub_all(events.filter(may), keys_l, value))


def _scrub_all(events: DataFrame, keys_l: list[str], value: str) -> DataFrame:
    cols = events.columns
    v = F.col(value)
    nested = (json_is_object(v) | json_is_array(v)) & F.try_parse_json(v).isNotNull()
    part = chunk_cols(events)
    leaf = "array<struct<leaf:int,text:string>>"
    leaves = (F.when(json_is_string(v), F.array(F.struct(F.lit(0).alias("leaf"), json_text(v).alias("text"))).cast(leaf))
              .when(nested, json_string_leaves(v).cast(leaf)).otherwise(F.array().cast(leaf)))
    x = events.select(F.struct(*cols).alias("__ev"), *keys_l, "ord", *part, F.explode_outer(leaves).alias("__l"))
    x = x.select("__ev", *keys_l, "ord", *part, F.coalesce(F.col("__l")["leaf"], F.lit(0)).alias("leaf"),
                 F.coalesce(F.col("__l")["text"], F.lit("")).alias("text"))
    x = scrub_leaves(x, "text", keys=keys_l)
    # regroup leaves into events on the numbering's partitioning: of the leaves, what changed
    changed_leaf = F.when(F.col("text") != F.col("scrubbed"), F.struct("leaf", "scrubbed"))
    g = x.groupBy(*keys_l, *part, "ord").agg(F.first("__ev").alias("__ev"), F.collect_list(changed_leaf).alias("__lv"))
    changed = F.size("__lv") > 0
    ev_v = F.col("__ev")[value]
    literals = F.map_from_entries(F.transform("__lv", lambda s: F.struct(s["leaf"], json_quote(s["scrubbed"]))))
    new_v = (F.when(~changed, ev_v).when(json_is_string(ev_v), json_quote(F.col("__lv")[0]["scrubbed"]))
             .otherwise(json_replace_leaves(ev_v, literals)))
    out = []
    for c in cols:
        if c == value:
            out.append(new_v.alias(c))
        elif c == "redacted":
            out.append((F.coalesce(F.col("__ev")["redacted"], F.lit(False)) | changed).alias(c))
        else:
            out.append(F.col("__ev")[c].alias(c))
    return g.select(*out)


def pii_gate(recordings: DataFrame, log: DataFrame, allow_pii: bool = False, keys="rec_id") -> DataFrame:
    """Per recording, redaction total and a warning flag.  Placeholders
    are always applied; ``allow_pii`` only silences the warning, and nothing
    is blocked (the recorded behaviour)."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    n = log.groupBy(*keys_l).agg(F.count(F.lit(1)).alias("n_redactions"))
    out = recordings.select(*keys_l).distinct().join(n, keys_l, "left")
    n_col = F.coalesce(F.col("n_redactions"), F.lit(0)).cast("long")
    return out.select(*keys_l, n_col.alias("n_redactions"),
                      ((n_col > 0) & F.lit(not allow_pii)).alias("warn"), F.lit(False).alias("blocked"))
