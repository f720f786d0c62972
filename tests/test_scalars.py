"""Column helpers against their plain statements."""
from math import log2

from clickloom.functions.scalars import shannon_entropy, ws_trim


def test_white_space_at_the_ends_and_entropy_of_any_characters(spark):
    ends = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    texts = ["", "a", "aaaa", "abab", ends + "a b" + ends, "\u200bx", "\U0001f600\U0001f600\U0001f601z", "x\n\nx", "ab" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("s", shannon_entropy("s").alias("h"), ws_trim("s").alias("t")).collect()
    for r in rows:
        shares = [r["s"].count(c) / len(r["s"]) for c in set(r["s"])]
        assert abs(r["h"] + sum(p * log2(p) for p in shares)) < 1e-9
        assert r["t"] == r["s"].strip(ends)
    plan = spark.createDataFrame([("a",)], "s string").select(shannon_entropy("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "(?!" not in plan and "array_sort" not in plan  # characters come and are sorted without patterns and comparators
