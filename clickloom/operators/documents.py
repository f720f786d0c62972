"""Document operators: render how-to documents and redaction reports, lint
them, decide what can be published (G1-G9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clickloom import model
from clickloom.functions.scalars import ws_trim

# --------------------------------------------------------------------------
# Document layout text.
# --------------------------------------------------------------------------
REFERENCE_MATERIALS = (
    "## Reference materials\n"
    "- `reference/original_recording.json` — the captured workflow\n"
    "- `reference/screenshots/` — frames from the recording\n"
    "- `reference/REDACTIONS.md` — record of every secret/PII replacement applied during build\n"
)
REPORT_HEADER = [
    "# Redactions applied during build",
    "",
    "Every value scrubbed from the recording before it was sent for labelling.",
    "Review before publishing.",
    "",
]
REPORT_TABLE_HEAD = ["| Event | Placeholder | Kind | Original length |", "|---|---|---|---|"]
REPORT_EMPTY = "_No redactions were applied._"
ISSUE_MISSING = "Missing SKILL.md in {}"
ISSUE_NO_FRONTMATTER = "SKILL.md is missing YAML frontmatter"
ISSUE_NO_NAME = "frontmatter missing `name`"
ISSUE_BAD_NAME = "`name` is not kebab-case or too long: "
ISSUE_NO_DESCRIPTION = "frontmatter missing `description`"
ISSUE_LONG_DESCRIPTION = "`description` exceeds 1024 characters"
ISSUE_BROKEN_IMAGE = "broken image reference: "

FRONTMATTER = r"(?s)\A---\n(.+?)\n---\n"
NAME_LINE = r"(?dmU)^name:\s*(.+)$"
DESCRIPTION_LINE = r"(?dmU)^description:\s*(.+)$"
IMAGE_REF = r"!\[\]\(([^)]+)\)"


def _bullets(arr: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(arr, F.array().cast("array<string>")),
                                    lambda b: F.concat(F.lit("- "), b, F.lit("\n"))), "")


def _nonempty(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def render_skill_md(drafts: DataFrame, surface: Column | str = "surface") -> Column:
    """G1: the SKILL.md text of a draft.  Steps are numbered by position; the
    step list is bounded by the segment cap."""
    d = drafts
    desc = ws_trim(F.replace(F.col("description"), F.lit("\n"), F.lit(" ")))
    head = F.concat(F.lit("---\nname: "), F.col("name"), F.lit("\ndescription: "), desc, F.lit("\n---\n\n# "),
                    F.col("title"), F.lit("\n\n## When to use this skill\n"), _bullets(F.col("when_to_use")), F.lit("\n"))
    prereq = F.when(F.size("prerequisites") > 0, F.concat(F.lit("\n## Prerequisites\n"), _bullets(F.col("prerequisites")),
                                                          F.lit("\n"))).otherwise(F.lit(""))
    inputs = F.when(F.size("inputs") > 0, F.concat(F.lit("\n## Inputs\nAsk the user for these before starting:\n"),
                                                   _bullets(F.col("inputs")), F.lit("\n"))).otherwise(F.lit(""))
    approach = F.concat(F.lit("## High-level approach\n"), F.col("high_level_approach"), F.lit("\n\n## Steps\n"))

    def step(s, i):
        fb = F.when(_nonempty(s["fallback"]), F.concat(F.lit("\n**If it fails:** "), s["fallback"], F.lit("\n"))).otherwise(F.lit(""))
        sp = F.when(_nonempty(s["screenshot_path"]), F.concat(F.lit("\n**Reference:** ![](reference/"), s["screenshot_path"],
                                                             F.lit(")\n"))).otherwise(F.lit(""))
        return F.concat(F.lit("\n### "), (i + 1).cast("string"), F.lit(". "), s["title"], F.lit("\n\n**Goal:** "), s["goal"],
                        F.lit("\n\n**Action:** "), s["action"], F.lit("\n\n**Expected result:** "), s["expected_result"],
                        F.lit("\n"), fb, sp, F.lit("\n"))

    steps = F.array_join(F.transform(F.col("steps"), step), "")
    fm = F.when(F.size("failure_modes") > 0, F.concat(F.lit("\n## Common failure modes\n"), _bullets(F.col("failure_modes")),
                                                      F.lit("\n"))).otherwise(F.lit(""))
    surf = F.col(surface) if isinstance(surface, str) else surface
    tail = F.concat(F.lit("\n\n## Success criteria\n"), _bullets(F.col("success_criteria")), F.lit("\n"), fm, F.lit("\n"),
                    F.lit(REFERENCE_MATERIALS), F.lit("\n## Surface\nThis skill was recorded on the **"), surf,
                    F.lit("** surface.\n"))
    return F.concat(head, prereq, inputs, approach, steps, tail)


def redaction_report_lines(log: DataFrame, recordings: DataFrame, keys="rec_id") -> DataFrame:
    """REDACTIONS report as ordered lines (``line_key`` sorts them).  Each
    log row renders to its own table line, so a recording with a huge log is
    never gathered in one task; recordings without redactions get the
    "no redactions" line."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    recs = recordings.select(*keys_l).distinct()
    has = log.select(*keys_l).distinct().withColumn("__has", F.lit(True))
    r = recs.join(has, keys_l, "left")
    hdr = F.array(*[F.struct(F.lit(i).alias("section"), F.lit(i).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"),
                             F.lit(0).alias("k3"), F.lit(0).alias("k4"), F.lit(t).alias("line"))
                    for i, t in enumerate(REPORT_HEADER)])
    n = len(REPORT_HEADER)
    table_head = F.array(*[F.struct(F.lit(n).alias("section"), F.lit(i).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"),
                                    F.lit(0).alias("k3"), F.lit(0).alias("k4"), F.lit(t).alias("line"))
                           for i, t in enumerate(REPORT_TABLE_HEAD)])
    empty = F.array(F.struct(F.lit(n).alias("section"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"),
                             F.lit(0).alias("k3"), F.lit(0).alias("k4"), F.lit(REPORT_EMPTY).alias("line")))
    fixed = r.select(*keys_l, F.explode(F.concat(hdr, F.when(F.col("__has"), table_head).otherwise(empty))).alias("l"))
    rows = log.select(*keys_l, F.struct(F.lit(n + 1).alias("section"), F.col("ord").cast("long").alias("k1"),
                                        F.col("leaf").cast("long").alias("k2"), F.col("kind_idx").alias("k3"),
                                        F.col("pos").alias("k4"),
                                        F.concat(F.lit("| `"), F.col("event_id"), F.lit("` | `"), F.col("placeholder"),
                                                 F.lit("` | "), F.col("kind"), F.lit(" | "),
                                                 F.col("original_length").cast("string"), F.lit(" |")).alias("line")).alias("l"))
    out = fixed.unionByName(rows)
    return out.select(*keys_l, F.col("l.section").alias("section"), F.col("l.k1").alias("k1"), F.col("l.k2").alias("k2"),
                      F.col("l.k3").alias("k3"), F.col("l.k4").alias("k4"), F.col("l.line").alias("line"))


def _py_repr(s: Column) -> Column:
    """Python ``repr`` of a plain string (quotes and backslashes escaped)."""
    esc = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    use_dq = s.contains("'") & ~s.contains('"')
    return F.when(use_dq, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))


def lint(docs: DataFrame, manifest: DataFrame, doc_key: str = "doc", text: str = "skill_md",
         doc_dir: str = "doc_dir") -> DataFrame:
    """Issues per document in rule order (empty list = valid).

    ``manifest`` holds ``(doc_key, path)`` of the files present beside the
    document; image references are checked with an anti join (G7)."""
    t = F.col(text)
    fm = F.regexp_extract(t, FRONTMATTER, 1)
    has_fm = t.isNotNull() & (fm != "")
    body = F.when(has_fm, F.substring(t, F.char_length(fm) + 10, F.lit(2 ** 31 - 1)))
    name_m = F.regexp_extract(fm, NAME_LINE, 1)
    has_name = fm.rlike(NAME_LINE)
    name_v = ws_trim(name_m)
    desc_m = F.regexp_extract(fm, DESCRIPTION_LINE, 1)
    has_desc = fm.rlike(DESCRIPTION_LINE)
    name_issue = (F.when(~has_name, F.lit(ISSUE_NO_NAME))
                  .when(~name_v.rlike(r"\A" + model.NAME_PATTERN + r"\z"), F.concat(F.lit(ISSUE_BAD_NAME), _py_repr(name_v))))
    desc_issue = (F.when(~has_desc, F.lit(ISSUE_NO_DESCRIPTION))
                  .when(F.char_length(ws_trim(desc_m)) > model.MAX_DESCRIPTION_CHARS, F.lit(ISSUE_LONG_DESCRIPTION)))
    base = docs.select(doc_key, doc_dir, text, has_fm.alias("__has_fm"), body.alias("__body"),
                       F.filter(F.array(name_issue, desc_issue), lambda x: x.isNotNull()).alias("__fm_issues"))

    refs = base.filter("__has_fm").select(doc_key, F.posexplode(F.regexp_extract_all("__body", F.lit(IMAGE_REF), 1)).alias("pos", "ref"))
    broken = refs.join(manifest.select(doc_key, F.col("path").alias("ref")), [doc_key, "ref"], "left_anti")
    broken = broken.groupBy(doc_key).agg(F.array_sort(F.collect_list(F.struct("pos", "ref"))).alias("__b"))
    out = base.join(broken, doc_key, "left")
    img = F.transform(F.coalesce(F.col("__b"), F.array().cast("array<struct<pos:int,ref:string>>")),
                      lambda b: F.concat(F.lit(ISSUE_BROKEN_IMAGE), b["ref"]))
    issues = (F.when(F.col(text).isNull(), F.array(F.concat(F.lit(ISSUE_MISSING.split("{}")[0]), F.col(doc_dir))))
              .when(~F.col("__has_fm"), F.array(F.lit(ISSUE_NO_FRONTMATTER)))
              .otherwise(F.concat(F.col("__fm_issues"), img)))
    return out.select(doc_key, issues.alias("issues"), (F.size(issues) == 0).alias("valid"))


def installable(docs: DataFrame, files: DataFrame, doc_key: str = "doc") -> DataFrame:
    """A document set can be published only if it contains SKILL.md."""
    return docs.join(files.filter(F.col("path") == "SKILL.md").select(doc_key), doc_key, "left_semi")
