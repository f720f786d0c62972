"""Token counts against the library itself."""
import random

import pytest
from pyspark.sql import functions as F

from clickloom.llm import token_counts
from clickloom.llm.common import coded_words
from .conftest import edge_rows, tuples


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(token_counts.default_tokenizer())


def expected(library, rows, limit=2048):
    out = []
    for r in rows:
        text = r[1] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        out.append((r[0], len(text.encode()), n, n > limit))
    return sorted(out, key=repr)


def test_counts_equal_the_library(spark, edge, none, library):
    got = tuples(token_counts.token_counts(edge), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == expected(library, edge_rows())
    assert any(r[3] for r in got) and not all(r[3] for r in got)
    assert token_counts.token_counts(none).count() == 0


def test_odd_characters_special_strings_and_long_words(spark, library):
    rng = random.Random(9)
    alphabet = "abcXYZ  \t\n\x0b\x1c\x1f\x7f\x85\xa0 ​0129.,!'´éÉßẞİΣςσ漢字🙂é́ͅǅﬁ-_<|>&"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "DON'T we'll 's", "ΑΣ ΣΑΣ", "\x00\x01 \x00",
              "".join(rng.choice("abcde") for _ in range(50_000)), "a" * 30_001, "é" * 5_000, None]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = tuples(token_counts.token_counts(df, limit=10), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == expected(library, rows, 10)


def test_counts_survive_forgetting(library, monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN", 8)
    with open(token_counts.default_tokenizer(), encoding="utf-8") as f:
        counter = token_counts.TokenCounter(f.read())
    words = [f"word{i % 23}ing" for i in range(200)]
    assert counter.count(words).tolist() == [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert len(counter.words) <= 4 and len(counter.words.old) <= 4


def test_vocabularies_that_keep_white_space_are_refused():
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        with pytest.raises(ValueError):
            token_counts.TokenCounter(f.read())


def test_words_in_slices():
    import pyarrow as pa
    texts = [" a b  a\t", None, "", "  ", "c", "b\x0bc\x1cd"] * 5
    for most in (1, 7, 1 << 22):
        lists = []
        for first, lengths, codes, words in coded_words(pa.array(texts), most=most):
            assert first == len(lists)
            found = [words[int(c)].as_py() for c in codes]
            for n in lengths:
                lists.append(found[:n])
                found = found[n:]
        assert lists == [[w.decode() for w in (t or "").encode().split()] for t in texts]
