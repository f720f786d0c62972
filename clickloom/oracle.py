"""DuckDB SQL for the correctness gate.

Independent set-based formulations of each registered query, written against
the driver's pre-registered views.  Shared CTEs are composed as text."""

from __future__ import annotations

from clickloom import model

GAP_TEST_MS = 21_600_000  # R0 users act every ~7 h; 6 h makes gaps informative

R0 = """
r0 AS (
  SELECT user_id AS rec_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS ord,
         event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms, k,
         CASE event_type WHEN 'purchase' THEN 'key' WHEN 'signup' THEN 'key'
           WHEN 'view' THEN CASE WHEN k%4=0 THEN 'navigate' WHEN k%4=1 THEN 'tab_switch' WHEN k%4=2 THEN 'scroll' ELSE 'click' END
           WHEN 'click' THEN CASE WHEN k%5=0 THEN 'file_upload' WHEN k%5=1 THEN 'input' ELSE 'click' END
           ELSE CASE WHEN k%6=0 THEN 'annotation' WHEN k%6=1 THEN 'screen_changed' WHEN k%6=2 THEN 'dom_settled'
                     WHEN k%6=3 THEN 'network_idle' ELSE 'scroll' END END AS type,
         CASE WHEN event_type IN ('purchase','signup') THEN CASE k%10 WHEN 0 THEN 'enter' WHEN 1 THEN 'Shift'
              WHEN 2 THEN 'f5' WHEN 3 THEN 'ctrl_l' ELSE chr(CAST(97 + k%26 AS INTEGER)) END END AS key,
         CASE WHEN event_type IN ('purchase','signup') THEN CASE WHEN k%11=0 THEN 'release' ELSE 'press' END END AS action,
         CASE WHEN event_type <> 'error' THEN concat('https://app.test/p', CAST(k%3 AS VARCHAR)) END AS url,
         CASE WHEN event_type IN ('click','view') AND k%2=0 THEN concat('screenshots/', CAST(k%7 AS VARCHAR), '.png') END AS screenshot_path
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
),
r0e AS (SELECT *, printf('evt_%04d', ord) AS id FROM r0)"""

_mods = ", ".join(f"'{m}'" for m in model.MODIFIER_KEYS)

COMPRESS = R0 + f""",
c1 AS (SELECT *, CASE WHEN type='key' AND length(key)=1 THEN 'char' WHEN type='scroll' THEN 'scroll' ELSE 'other' END AS kind
       FROM r0e WHERE NOT (type='key' AND (action <> 'press' OR lower(key) IN ({_mods})))),
c2 AS (SELECT *, lag(kind) OVER w AS pk, lead(kind) OVER w AS nk FROM c1 WINDOW w AS (PARTITION BY rec_id ORDER BY ord)),
c3 AS (SELECT *, sum(CASE WHEN kind='other' OR pk IS NULL OR pk<>kind THEN 1 ELSE 0 END)
                   OVER (PARTITION BY rec_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM c2),
comp AS (
  SELECT rec_id, ord, id, ts_ms, type, key, url, screenshot_path, CAST(NULL AS VARCHAR) AS text, kind
  FROM c3 WHERE kind='other' OR (kind='scroll' AND (nk IS NULL OR nk<>'scroll'))
  UNION ALL
  SELECT rec_id, min(ord), arg_min_null(id, ord), arg_min_null(ts_ms, ord), 'input', arg_min_null(key, ord),
         arg_min_null(url, ord), arg_min_null(screenshot_path, ord), string_agg(key, '' ORDER BY ord), 'char'
  FROM c3 WHERE kind='char' GROUP BY rec_id, run)"""

_verb_case = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in model.VERB_GROUPS.items()) + " ELSE {c} END"
_focus = ", ".join(f"'{t}'" for t in model.FOCUS_TAB_TYPES)


def segment_sql(gap_ms: int, threshold: int = model.DEFAULT_THRESHOLD) -> str:
    return COMPRESS + f""",
s0 AS (SELECT *, {_verb_case.format(c='type')} AS verb FROM comp),
s1 AS (SELECT *, lag(type) OVER w AS pt, lag(url) OVER w AS pu, lag(ts_ms) OVER w AS pts, lag(verb) OVER w AS pv
       FROM s0 WINDOW w AS (PARTITION BY rec_id ORDER BY ord)),
s2 AS (SELECT *,
  CASE WHEN pt IS NULL THEN 0 WHEN type='navigate' THEN 3
       WHEN coalesce(url,'')<>'' AND coalesce(pu,'')<>'' AND url<>pu THEN 3 ELSE 0 END AS sig_nav_url,
  CASE WHEN pt IS NOT NULL AND type IN ({_focus}) THEN 3 ELSE 0 END AS sig_focus_tab,
  CASE WHEN pt IS NOT NULL AND type='annotation' THEN 3 ELSE 0 END AS sig_form_submit,
  CASE WHEN pt IS NOT NULL AND type='key' AND lower(key)='enter' AND pt='input' THEN 3 ELSE 0 END AS sig_enter_after_input,
  CASE WHEN pt IS NOT NULL AND type='network_idle' AND pt='dom_settled' THEN 3 ELSE 0 END AS sig_network_idle,
  CASE WHEN pt IS NOT NULL AND type='screen_changed' THEN 2 ELSE 0 END AS sig_screen_changed,
  CASE WHEN pt IS NOT NULL AND ts_ms - pts >= {gap_ms} THEN 2 ELSE 0 END AS sig_gap,
  CASE WHEN pt IS NOT NULL AND verb <> pv THEN 1 ELSE 0 END AS sig_verb_change
  FROM s1),
s3 AS (SELECT *, sig_nav_url + sig_focus_tab + sig_form_submit + sig_enter_after_input + sig_network_idle
                 + sig_screen_changed + sig_gap + sig_verb_change AS weight,
  concat_ws(',',
    CASE WHEN pt IS NOT NULL AND type='navigate' THEN 'navigate' END,
    CASE WHEN pt IS NOT NULL AND type<>'navigate' AND sig_nav_url>0 THEN 'url_change' END,
    CASE WHEN sig_focus_tab>0 THEN type END,
    CASE WHEN sig_form_submit>0 THEN 'form_submit' END,
    CASE WHEN sig_enter_after_input>0 THEN 'enter_after_input' END,
    CASE WHEN sig_network_idle>0 THEN 'network_idle_after_dom_settled' END,
    CASE WHEN sig_screen_changed>0 THEN 'screen_changed' END,
    CASE WHEN sig_gap>0 THEN concat('gap_', CAST(ts_ms - pts AS VARCHAR), 'ms') END,
    CASE WHEN sig_verb_change>0 THEN 'verb_change' END) AS reasons
  FROM s2),
seg AS (SELECT *, CAST(sum(CASE WHEN weight >= {threshold} THEN 1 ELSE 0 END)
                       OVER (PARTITION BY rec_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM s3)"""


def capped_sql(gap_ms: int, cap: int = model.DEFAULT_MAX_SEGMENTS) -> str:
    """D12 as a recursive CTE over per-recording segment-size lists."""
    return "WITH RECURSIVE " + segment_sql(gap_ms).lstrip() + f""",
segn AS (SELECT rec_id, seg, count(*) AS n FROM seg GROUP BY rec_id, seg),
cap0 AS (SELECT rec_id, list(n ORDER BY seg) AS ns, list(seg ORDER BY seg) AS anchors FROM segn GROUP BY rec_id),
capr AS (
  SELECT rec_id, ns, anchors FROM cap0
  UNION ALL
  SELECT rec_id,
         list_concat(list_slice(ns, 1, v - 2), [ns[v - 1] + ns[v]], list_slice(ns, v + 1, len(ns))),
         list_concat(list_slice(anchors, 1, v - 1), list_slice(anchors, v + 1, len(anchors)))
  FROM (SELECT *, list_position(list_slice(ns, 2, len(ns)), list_min(list_slice(ns, 2, len(ns)))) + 1 AS v
        FROM capr WHERE len(ns) > {cap}) t
),
capfin AS (SELECT rec_id, anchors FROM capr WHERE len(ns) <= {cap}),
capped AS (SELECT s.* REPLACE (CAST(len(list_filter(c.anchors, lambda a: a <= s.seg)) - 1 AS BIGINT) AS seg)
           FROM seg s JOIN capfin c USING (rec_id))"""


SUMMARY_COLS = """rec_id, seg, CAST(arg_max_null(ts_ms, ord) - arg_min_null(ts_ms, ord) AS BIGINT) AS duration_ms,
  CAST(count(*) AS BIGINT) AS event_count,
  arg_max(screenshot_path, ord) FILTER (WHERE screenshot_path IS NOT NULL AND screenshot_path <> '') AS boundary_screenshot"""


# ------------------------------------------------------------------ R1 / E
def _seed_sql() -> str:
    from clickloom.sources.bindings import SEED_SECRETS
    import re as _re
    whens = []
    for r, tmpl in SEED_SECRETS:
        parts = []
        for lit, pad in _re.findall(r"([^{]*)(?:\{p(\d+)\})?", tmpl):
            if lit:
                parts.append("'" + lit + "'")
            if pad:
                parts.append(f"lpad(CAST(doc_id AS VARCHAR), {pad}, '0')")
        whens.append(f"WHEN {r} THEN ' ' || " + " || ".join(parts))
    return "CASE doc_id % 9 " + " ".join(whens) + " ELSE '' END"


R1 = f"""
r1 AS (SELECT source AS rec_id, doc_id AS ord, CAST(0 AS BIGINT) AS leaf, doc_id,
              printf('doc_%d', doc_id) AS id, text || {_seed_sql()} AS text FROM documents)"""

KINDS = [k for k, _ in model.REDACTION_PATTERNS] + [model.HIGH_ENTROPY_KIND]


def redact_sql(base: str, src: str) -> str:
    """CTEs e0..e9 (detect), eo (offsets), es (rebuilt ``scrubbed``) over ``src``
    with columns rec_id, ord, leaf, id, text."""
    ctes = [f"e0 AS (SELECT *, text AS t0 FROM {src})"]
    for i, (kind, pat) in enumerate(model.REDACTION_PATTERNS):
        ctes.append(f"e{i + 1} AS (SELECT *, list_transform(regexp_extract_all(t{i}, '{pat}'), lambda m: length(m)) AS len_{kind}, "
                    f"regexp_replace(t{i}, '{pat}', chr({0xE000 + i}), 'g') AS t{i + 1} FROM e{i})")
    n = len(model.REDACTION_PATTERNS)
    he = model.HIGH_ENTROPY_KIND
    cond = (f"length(t{n}) >= {model.HIGH_ENTROPY_MIN_LEN} AND position('<' IN t{n}) = 0 "
            f"AND NOT regexp_matches(t{n}, '[{chr(0xE000)}-{chr(0xE000 + n - 1)}]') "
            f"AND position(' ' IN regexp_replace(t{n}, '^\\s+|\\s+$', '', 'g')) = 0 "
            f"AND regexp_matches(t{n}, '\\pL') AND regexp_matches(t{n}, '\\p{{Nd}}') "
            f"AND list_aggregate(string_split(t{n}, ''), 'entropy') >= {model.HIGH_ENTROPY_THRESHOLD}")
    counts = ", ".join(f"CAST(len(len_{k}) AS BIGINT) AS n_{k}" for k in KINDS)
    ctes.append(f"eh AS (SELECT *, CASE WHEN {cond} THEN [length(t{n})] ELSE CAST([] AS BIGINT[]) END AS len_{he} FROM e{n})")
    ctes.append(f"ec AS (SELECT *, {counts} FROM eh)")
    offs = ", ".join(f"CAST(coalesce(sum(n_{k}) OVER w, 0) AS BIGINT) AS off_{k}" for k in KINDS)
    ctes.append(f"eo AS (SELECT *, {offs} FROM ec WINDOW w AS (PARTITION BY rec_id ORDER BY ord, leaf "
                f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
    prev = "eo"
    col = f"t{n}"
    for i, kind in enumerate(KINDS[:-1]):
        ctes.append(f"eb{i} AS (SELECT *, CASE WHEN n_{kind} > 0 THEN array_to_string(list_transform(string_split({col}, chr({0xE000 + i})), "
                    f"lambda p, j: CASE WHEN j = 1 THEN p ELSE '<{kind}_' || CAST(off_{kind} + j - 1 AS VARCHAR) || '>' || p END), '') "
                    f"ELSE {col} END AS b{i} FROM {prev})")
        prev, col = f"eb{i}", f"b{i}"
    ctes.append(f"es AS (SELECT *, CASE WHEN n_{he} > 0 THEN '<{he}_' || CAST(off_{he} + 1 AS VARCHAR) || '>' ELSE {col} END "
                f"AS scrubbed FROM {prev})")
    return base + ",\n" + ",\n".join(ctes)


def redaction_log_sql(src: str = "es") -> str:
    """One row per replacement; a single pass over ``src`` (one unnest)."""
    items = ", ".join(
        f"list_transform(len_{k}, lambda l, i: {{'kind_idx': {i}, 'pos': i - 1, 'kind': '{k}', 'n': off_{k} + i, 'l': l}})"
        for i, k in enumerate(KINDS))
    return (f"SELECT rec_id, ord, leaf, CAST(it.kind_idx AS INTEGER) AS kind_idx, CAST(it.pos AS INTEGER) AS pos, "
            f"event_id, '<' || it.kind || '_' || CAST(it.n AS VARCHAR) || '>' AS placeholder, it.kind AS kind, "
            f"CAST(it.l AS BIGINT) AS original_length FROM (SELECT rec_id, ord, leaf, id AS event_id, "
            f"unnest(list_concat({items})) AS it FROM {src}) x")


TOKENS_SQL = """
tok AS (SELECT doc_id, CAST(t.pos AS BIGINT) AS pos, t.token
        FROM r1, (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n]+')) AS token,
                         generate_subscripts(regexp_split_to_array(text, '[ \\t\\n]+'), 1) AS pos) t
        WHERE t.token <> '')"""


# ------------------------------------------------------------------ R4 / R5
R4 = """
r4 AS (SELECT c.conv_id, c.turn, c.turn AS arrival,
  CASE WHEN (c.conv_id + c.turn) % 8 = 7 THEN NULL
       WHEN c.conv_id % 5 = 0 THEN '{"intent": ' || it || ''
       WHEN c.conv_id % 5 = 1 THEN '{"target_description": null, "expected_outcome": "done", "confidence": "' || cf || '"}'
       WHEN c.conv_id % 5 = 2 THEN '{"intent": ' || it || ', "target_description": null, "expected_outcome": "done", "confidence": "' || cf || '", "extra": 1}'
       WHEN c.conv_id % 5 = 3 THEN '{"intent": ' || it || ', "target_description": "t' || CAST(c.turn AS VARCHAR) || '", "expected_outcome": null}'
       ELSE '{"intent": ' || it || ', "target_description": "t' || CAST(c.turn AS VARCHAR) || '", "expected_outcome": "done", "confidence": "' || cf || '"}' END AS response
  FROM (SELECT conv_id, turn, CAST(to_json(text) AS VARCHAR) AS it FROM conversations) c
  LEFT JOIN (SELECT doc_id AS conv_id, toxic, quality FROM labels) l USING (conv_id),
  LATERAL (SELECT CASE WHEN l.toxic = 1 THEN 'low' WHEN l.quality = 1 THEN 'high' ELSE 'medium' END AS cf) z),
r4p AS (SELECT *, coalesce(json_valid(response), false) AND json_type(response) = 'OBJECT' AS valid FROM r4),
labels_parsed AS (SELECT conv_id, turn, arrival, json_extract_string(response, '$.intent') AS intent,
  json_extract_string(response, '$.target_description') AS target_description,
  json_extract_string(response, '$.expected_outcome') AS expected_outcome,
  CASE WHEN list_contains(json_keys(response), 'confidence') THEN json_extract_string(response, '$.confidence') ELSE 'low' END AS confidence
  FROM r4p WHERE valid AND list_contains(json_keys(response), 'intent'))"""

R5 = """
r5s AS (SELECT conv_id, turn, text AS title,
  CASE WHEN turn % 2 = 0 THEN 'retry' END AS fallback,
  CASE WHEN turn % 3 = 0 THEN 'screenshots/' || CAST(turn AS VARCHAR) || '.png' END AS screenshot_path,
  text AS t60 FROM conversations),
r5 AS (SELECT conv_id,
  CASE WHEN conv_id % 6 = 0 THEN 'Bad Name ' || CAST(conv_id AS VARCHAR) ELSE 'skill-' || CAST(conv_id AS VARCHAR) END AS name,
  CASE WHEN conv_id % 6 = 1 THEN repeat('x', 1100) ELSE 'Use when ' || arg_min(t60, turn) END AS description,
  'Skill ' || CAST(conv_id AS VARCHAR) AS title,
  ['when ' || CAST(conv_id AS VARCHAR)] AS when_to_use,
  CASE WHEN conv_id % 2 = 0 THEN ['account'] ELSE CAST([] AS VARCHAR[]) END AS prerequisites,
  CASE WHEN conv_id % 3 = 0 THEN ['file'] ELSE CAST([] AS VARCHAR[]) END AS inputs,
  'Do it' AS high_level_approach,
  list({'index': turn, 'title': title, 'fallback': fallback, 'screenshot_path': screenshot_path} ORDER BY turn) AS steps,
  ['done'] AS success_criteria,
  CASE WHEN conv_id % 4 = 0 THEN ['fails'] ELSE CAST([] AS VARCHAR[]) END AS failure_modes
  FROM r5s GROUP BY conv_id)"""


def E(s: str) -> str:
    """DuckDB escape-string literal."""
    return "E'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _bul(a: str) -> str:
    return f"array_to_string(list_transform({a}, lambda b: '- ' || b || chr(10)), '')"


def render_sql(src: str = "r5", surface: str = "'browser'") -> str:
    from clickloom.operators.documents import REFERENCE_MATERIALS
    step = ("list_transform(steps, lambda s, i: " + E("\n### ") + " || CAST(i AS VARCHAR) || '. ' || s.title || "
            + E("\n\n**Goal:** ") + " || 'g' || " + E("\n\n**Action:** ") + " || 'a' || " + E("\n\n**Expected result:** ")
            + " || 'e' || chr(10) || CASE WHEN coalesce(s.fallback, '') <> '' THEN " + E("\n**If it fails:** ")
            + " || s.fallback || chr(10) ELSE '' END || CASE WHEN coalesce(s.screenshot_path, '') <> '' THEN "
            + E("\n**Reference:** ![](reference/") + " || s.screenshot_path || ')' || chr(10) ELSE '' END || chr(10))")
    return (f"SELECT conv_id, " + E("---\nname: ") + " || name || " + E("\ndescription: ")
            + " || regexp_replace(replace(description, chr(10), ' '), '^\\s+|\\s+$', '', 'g') || " + E("\n---\n\n# ")
            + " || title || " + E("\n\n## When to use this skill\n") + f" || {_bul('when_to_use')} || chr(10) || "
            + f"CASE WHEN len(prerequisites) > 0 THEN {E(chr(10) + '## Prerequisites' + chr(10))} || {_bul('prerequisites')} || chr(10) ELSE '' END || "
            + f"CASE WHEN len(inputs) > 0 THEN {E(chr(10) + '## Inputs' + chr(10) + 'Ask the user for these before starting:' + chr(10))} || {_bul('inputs')} || chr(10) ELSE '' END || "
            + E("## High-level approach\n") + " || high_level_approach || " + E("\n\n## Steps\n")
            + f" || array_to_string({step}, '') || " + E("\n\n## Success criteria\n") + f" || {_bul('success_criteria')} || chr(10) || "
            + f"CASE WHEN len(failure_modes) > 0 THEN {E(chr(10) + '## Common failure modes' + chr(10))} || {_bul('failure_modes')} || chr(10) ELSE '' END || chr(10) || "
            + E(REFERENCE_MATERIALS) + " || " + E("\n## Surface\nThis skill was recorded on the **") + f" || {surface} || "
            + E("** surface.\n") + f" AS skill_md FROM {src}")


# ------------------------------------------------------------------ R2
def _click(eid: str, ts: str, extra: str) -> str:
    return (f"'{{\"id\": \"{eid}\", \"ts_ms\": ' || {ts} || ', \"type\": \"click\", \"target\": {{\"url\": \"' || url || '\"}}"
            + extra.replace("'", "''") + "}'")


_STARTED = '"started_at": "2024-04-26T10:00:00Z", "ended_at": "2024-04-26T10:05:00Z"'


_TOLD = """' || ', "metadata": {"os": "Linux", "viewport": {"w": 800, "h": 600}, "user_intent_hint": ' || CAST(to_json(url) AS VARCHAR)
   || '}, "notes": [{"ts_ms": ' || CAST(ts0 AS VARCHAR) || ', "text": ' || CAST(to_json(html) AS VARCHAR) || '}]' || '"""


def _wrap(events: str, surface: str = "browser", more: str = "", told: bool = False) -> str:
    return f"'{{\"surface\": \"{surface}\", {_STARTED}{_TOLD if told else more}, \"events\": ' || {events} || '}}'"


R2 = f"""
r2b AS (SELECT page_id, url, html, 1714125600000 + page_id * 1000 AS ts0 FROM pages),
r2 AS (SELECT page_id,
  CASE WHEN url LIKE '%?%' THEN '/upload' ELSE '/recordings' END AS path,
  CASE WHEN starts_with(url, 'https') THEN 'chrome-extension://abc' WHEN url LIKE '%blog%' THEN 'moz-extension://def'
       ELSE 'http://evil.example' END AS origin,
  CASE page_id % 8 WHEN 0 THEN ''
    WHEN 1 THEN '{{"surface": "browser", "events": ['
    WHEN 2 THEN {_wrap("'[]'", surface="desktop")}
    WHEN 3 THEN {_wrap("'{\"a\": 1}'")}
    WHEN 4 THEN {_wrap("'[' || " + _click("evt_in_1", "CAST(ts0 AS VARCHAR)", ', "screenshot_data": "abcde"') + " || ']'")}
    WHEN 5 THEN {_wrap("'[' || " + _click("evt_in_1", "CAST(ts0 AS VARCHAR) || '.75'", "") + " || ', ' || "
                       + _click("evt_in_2", "CAST(ts0 + 1500 AS VARCHAR) || '.25'", ', "surface": "browser"') + " || ']'", told=True)}
    WHEN 6 THEN {_wrap("'[' || " + _click("evt_in_1", "CAST(ts0 AS VARCHAR)", ', "screenshot_data": "iVBORw0KGgo="') + " || ', ' || "
                       + _click("evt_in_2", "CAST(ts0 + 700 AS VARCHAR)", ', "value": "typed a@b.co"') + " || ']'",
                       more=', "metadata": {"browser": "x"}')}
    ELSE '[1, 2]' END AS body FROM r2b),
r2e AS (SELECT *, CASE WHEN json_valid(body) AND json_type(body, '$.events') = 'ARRAY'
                   THEN CAST(json_extract(body, '$.events[*]') AS VARCHAR[]) ELSE CAST([] AS VARCHAR[]) END AS evs FROM r2),
r2s AS (SELECT page_id, path, origin, body, CAST(octet_length(encode(body)) AS BIGINT) AS content_length, CASE
  WHEN path <> '/recordings' THEN 404 WHEN NOT (starts_with(origin, 'chrome-extension://') OR starts_with(origin, 'moz-extension://')) THEN 403
  WHEN octet_length(encode(body)) <= 0 THEN 400 WHEN NOT json_valid(body) THEN 400 WHEN json_type(body) <> 'OBJECT' THEN 500
  WHEN coalesce(json_type(body, '$.events'), '') <> 'ARRAY' THEN 422
  WHEN NOT list_bool_and(list_transform(evs, lambda e: json_type(e) = 'OBJECT')) THEN 422
  WHEN NOT list_bool_and(list_transform(evs, lambda e: json_extract_string(e, '$.screenshot_data') IS NULL
        OR json_extract_string(e, '$.screenshot_data') = ''
        OR length(regexp_replace(json_extract_string(e, '$.screenshot_data'), '[^A-Za-z0-9+/]', '', 'g')) % 4 = 0
        OR (length(regexp_replace(json_extract_string(e, '$.screenshot_data'), '[^A-Za-z0-9+/]', '', 'g')) % 4 = 2
            AND length(regexp_replace(json_extract_string(e, '$.screenshot_data'), '[^=]', '', 'g')) >= 2)
        OR (length(regexp_replace(json_extract_string(e, '$.screenshot_data'), '[^A-Za-z0-9+/]', '', 'g')) % 4 = 3
            AND length(regexp_replace(json_extract_string(e, '$.screenshot_data'), '[^=]', '', 'g')) >= 1))) THEN 422
  WHEN coalesce(json_extract_string(body, '$.surface'), '') <> 'browser' THEN 422
  WHEN json_extract_string(body, '$.started_at') IS NULL OR json_extract_string(body, '$.ended_at') IS NULL
    OR NOT list_bool_and(list_transform(evs, lambda e: TRY_CAST(json_extract_string(e, '$.ts_ms') AS DOUBLE) IS NOT NULL
        AND coalesce(json_extract_string(e, '$.type') IN ({", ".join(repr(t) for t in model.EVENT_TYPES)}), false)
        AND coalesce(CASE WHEN json_exists(e, '$.surface') THEN json_extract_string(e, '$.surface') ELSE 'browser' END
            IN ('browser', 'desktop'), false))) THEN 422
  ELSE 201 END AS status, evs FROM r2e),
r2ev AS (SELECT page_id, CAST(u.pos AS BIGINT) AS ord, printf('evt_%04d', u.pos) AS id, json_extract_string(u.e, '$.id') AS orig_id,
  CAST(trunc(CAST(json_extract_string(u.e, '$.ts_ms') AS DOUBLE)) AS BIGINT) AS ts_ms,
  CASE WHEN json_exists(u.e, '$.surface') THEN json_extract_string(u.e, '$.surface') ELSE 'browser' END AS surface,
  json_extract_string(u.e, '$.type') AS type,
  json_extract_string(u.e, '$.screenshot_data') AS sd FROM r2s, (SELECT unnest(evs) AS e, generate_subscripts(evs, 1) AS pos) u
  WHERE status = 201)"""

# What the recorder knew of an R0 recording, and its notes
_ISO = "strftime(make_timestamp({0} * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"
R3 = f"""
r3h AS (SELECT conv_id AS rec_id, arg_min(text, turn) AS hint FROM conversations WHERE role = 'user' GROUP BY conv_id),
r3n AS (SELECT conv_id AS rec_id, CAST(count(*) AS BIGINT) AS n_notes,
    md5(string_agg(CAST(1714125600000 + turn * 1000 AS VARCHAR) || ':' || text, chr(10) ORDER BY turn)) AS notes_md5 FROM conversations GROUP BY conv_id),
r3 AS (SELECT rec_id, '1.0' AS version, 'desktop' AS surface, {_ISO.format("min(ts_ms)")} AS started_at, {_ISO.format("max(ts_ms)")} AS ended_at,
    'Linux' AS os, CAST(CASE WHEN rec_id % 3 <> 0 THEN 1000 + rec_id % 7 END AS BIGINT) AS viewport_w,
    CASE WHEN rec_id % 3 <> 0 THEN CASE WHEN rec_id % 2 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END END AS dpr,
    CAST(count(*) AS BIGINT) AS n_events, min(ts_ms) AS started_ms, max(ts_ms) AS ended_ms, arg_min(id, ord) AS first_id, arg_max(id, ord) AS last_id
  FROM r0e GROUP BY rec_id)"""
R3_ENVELOPE = """SELECT r3.rec_id, version, surface, started_at, ended_at, os, viewport_w, dpr, hint, coalesce(n_notes, 0) AS n_notes,
  coalesce(notes_md5, md5('')) AS notes_md5, n_events FROM r3 LEFT JOIN r3h USING (rec_id) LEFT JOIN r3n USING (rec_id)"""

# Uploads with one wrong field, and what a look at each field's JSON type says of them
_R6_TYPES = [
    ("metadata.os", "'VARCHAR', 'NULL'", "not a string"), ("events[0].target.selector_alternatives.css", "'VARCHAR', 'NULL'", "not a string"),
    ("events[0].target.frame_path", "'ARRAY'", "not an array"), ("events[0].target.shadow_path[1]", "'VARCHAR'", "null"),
    ("events[0].target.url", "'VARCHAR', 'NULL'", "not a string"), ("events[0].viewport.dpr", "'DOUBLE', 'UBIGINT', 'BIGINT'", "not a number"),
    ("events[0].redacted", "'BOOLEAN'", "not a boolean"), ("notes[0].ts_ms", "'UBIGINT', 'BIGINT', 'VARCHAR'", "not an integer")]
_R6_NEEDED = [("metadata.viewport", "h"), ("events[0].target.viewport_box", "h"), ("notes[1]", "ts_ms")]


def _r6_path(p: str) -> str:
    return p.replace("[", ".").replace("]", "")


R6 = r"""
r6 AS (SELECT page_id, '{"surface": "browser", "started_at": "2024-04-26T10:00:00Z", "ended_at": "2024-04-26T10:05:00Z", "metadata": '
  || CASE page_id % 12 WHEN 6 THEN '{"os": 5}' WHEN 7 THEN '{"viewport": {"w": 10}}' ELSE '{"os": null}' END || ', "notes": '
  || CASE page_id % 12 WHEN 8 THEN '[{"ts_ms": 1, "text": ' || CAST(to_json(html) AS VARCHAR) || '}, {"text": "t"}]' WHEN 9 THEN '[{"ts_ms": 1.5, "text": "t"}]'
     ELSE '[{"ts_ms": "7", "text": ' || CAST(to_json(html) AS VARCHAR) || '}]' END || ', "events": [{"id": "a", "ts_ms": 3, "type": "click", "target": '
  || CASE page_id % 12 WHEN 1 THEN '{"url": 5}' WHEN 2 THEN '{"frame_path": "top"}' WHEN 3 THEN '{"selector_alternatives": {"css": [1], "text": null}}'
     WHEN 4 THEN '{"viewport_box": {"x": 1, "y": 2, "w": 3}}' WHEN 11 THEN '{"shadow_path": ["a", null]}'
     ELSE '{"url": ' || CAST(to_json(url) AS VARCHAR) || ', "viewport_box": null}' END || ', "viewport": '
  || CASE page_id % 12 WHEN 5 THEN '{"w": 1, "h": 2, "dpr": "wide"}' ELSE '{"w": 1, "h": "2", "dpr": 1.5}' END
  || ', "redacted": ' || CASE page_id % 12 WHEN 10 THEN '"maybe"' ELSE 'false' END || '}]}' AS body FROM pages),
r6p AS (SELECT *, found[1] AS first FROM (SELECT page_id, list_filter([
""" + ",\n".join([f"  CASE WHEN json_type(body, '$.{p}') NOT IN ({ok}) THEN '{_r6_path(p)}: {why}' END" for p, ok, why in _R6_TYPES]
                 + [f"  CASE WHEN json_type(body, '$.{p}') = 'OBJECT' AND json_type(body, '$.{p}.{k}') IS NULL THEN '{_r6_path(p)}.{k}: missing' END"
                    for p, k in _R6_NEEDED]) + """], lambda x: x IS NOT NULL) AS found FROM r6) x)"""
