from pyspark.sql import functions as F

from clickloom.operators.documents import lint


def _lint(spark, text, refs_present=()):
    docs = spark.createDataFrame([(1, text, "skill")], "doc bigint, skill_md string, doc_dir string")
    mf = spark.createDataFrame([(1, p) for p in refs_present] or [(1, "SKILL.md")], "doc bigint, path string")
    return lint(docs, mf).collect()[0]["issues"]


def _doc(*front, body="Some steps."):
    return "\n".join(["---", *front, "---", "", body, ""])


def test_every_rule_fires_on_its_own(spark):
    name, about = "name: tidy-desk-2", "description: Tidy the desk."
    assert _lint(spark, _doc(name, about)) == []
    assert _lint(spark, _doc("name: 4t", about)) == []  # two characters are enough
    for bad in ("x", "-ab", "ab-", "Tidy-Desk", "tidy desk", "a" * 65):
        issues = _lint(spark, _doc(f"name: {bad}", about))
        assert len(issues) == 1 and issues[0].startswith("`name`") and repr(bad) in issues[0]
    assert _lint(spark, _doc(about)) == ["frontmatter missing `name`"]
    assert _lint(spark, _doc(name)) == ["frontmatter missing `description`"]
    assert _lint(spark, _doc(name, "description: " + "d" * 1024)) == []
    assert _lint(spark, _doc(name, "description: " + "d" * 1025)) == ["`description` exceeds 1024 characters"]


def test_images_are_looked_up_in_order(spark):
    text = _doc("name: ab", "description: d", body="![](a/1.png) ![alt](not/checked.png)\n![](b/2.png)")
    assert _lint(spark, text) == ["broken image reference: a/1.png", "broken image reference: b/2.png"]
    assert _lint(spark, text, ["a/1.png"]) == ["broken image reference: b/2.png"]
    assert _lint(spark, text, ["a/1.png", "b/2.png"]) == []


def test_missing_and_no_frontmatter(spark):
    assert _lint(spark, None)[0].startswith("Missing SKILL.md")
    assert _lint(spark, "# no frontmatter\n") == ["SKILL.md is missing YAML frontmatter"]
