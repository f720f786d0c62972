"""Token files beside what test_texts.py holds: refused vocabularies, long runs of one id, views instead of copies."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import token_files
from clickloom.session import scratch_path


def test_vocabularies_that_keep_white_space_are_refused():
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        with pytest.raises(ValueError):
            token_files.WordEncoder(f.read())


def test_a_long_run_of_one_id_fills_several_files_that_several_tasks_read(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("same words "), F.col("id") % 3).alias("text")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = token_files.write_sequences(df, scratch_path(spark, "tokens"), seq_len=32)
        read = token_files.read_documents(files)
        rows = read.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert files.count() > 2 and len({r["task"] for r in rows}) > 1 and max(f["n_tokens"] for f in files.collect()) < 12_000
    rows.sort(key=lambda r: r["start"])
    assert len(rows) == 4000 and [r["start"] for r in rows] == [4 * i for i in range(4000)]
    f = files.orderBy("part").first()
    ids, mask = token_files.SequenceFile(f["path"])[0]
    assert not ids.flags.owndata and mask.all()
    a, b = token_files.SequenceFile(f["path"]).sequence(0)
    assert a.to_pylist() == ids.tolist() and len(b) == 32 and b.true_count == 32


def test_words_in_upper_case_and_added_tokens(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(token_files.default_tokenizer())
    texts = ["The THE the", "x <|ENDOFTEXT|> y", "x <|endoftext|>Y", "İSTANBUL Straße ÉA É", "", None, "A\u0301b"]
    for rows in (texts, texts[:1], texts[1:2]):
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
        got = {r["doc_id"]: r["ids_crc32"] for r in token_files.token_documents(df).collect()}
        for i, x in enumerate(rows):
            ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
            assert got[i] == zlib.crc32(np.array(ids, "<u4").tobytes()), x


def test_words_are_forgotten_by_halves(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_WORDS", 6)
    with open(token_files.default_tokenizer(), encoding="utf-8") as f:
        encoder = token_files.WordEncoder(f.read())
    for at in range(0, 60, 2):
        words = [f"w{(at + k) % 17}" for k in range(4)]
        got = encoder.words(words)
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [encoder.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
        assert len(encoder.known) <= 8 and len(encoder.old) <= 8
