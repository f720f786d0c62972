import random

import pytest

CLASHING = ["id", "key", "score", "row", "size", "shard", "slot", "copies", "class", "h", "bin", "x", "n", "content", "start", "held_out"]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          + ", ".join(f"{c} string" for c in CLASHING))


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    """Plain documents with every awkward case: nulls, empty and very long texts, copies, near copies, shared
    passages, odd white space, other scripts, repeated rows."""
    rng = random.Random(4)
    rows = []

    def add(text, source="a", lang="en", doc_id=-1):
        i = len(rows) if doc_id == -1 else doc_id
        rows.append((i, text, lang, source, None if text is None else len(text), *["clash"] * len(CLASHING)))

    passage = words(rng, 60)
    for k in range(40):
        add(words(rng, rng.randrange(1, 120)), source="hot" if k % 3 else f"s{k}")
    base = words(rng, 80).split()
    for k in range(12):  # near copies
        copy = list(base)
        copy[5 * k % 80] = f"new{k}"
        add(" ".join(copy))
    for _ in range(5):
        add(" ".join(base))  # exact copies
        add(words(rng, 30) + " " + passage + " " + words(rng, 20))
    add(None), add(""), add("   \n\t "), add("one"), add("two words"), add("a b c d"), add("a b c d"), add("A B C D")
    add("\x1codd\x1dspaces and more \x0b tab\x0cend", source=None)
    add("Ünïcödé ẞtraße İstanbul 漢字 🙂 naïve", lang=None)
    add("123 456 !!! ???", lang="de")
    add("<|endoftext|> it's 12 don't")
    add(words(rng, 60_000, 30_000), source="long")
    add("x" * 100_000)
    add("same row", doc_id=500), add("same row", doc_id=500)
    add("no id", doc_id=None), add("no id", doc_id=None), add(None, source=None, lang=None, doc_id=None)
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
