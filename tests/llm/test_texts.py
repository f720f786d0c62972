"""Text operators against brute force over awkward documents."""
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import decontam, kneser_ney, langid, neardup, quality, substring, token_files
from clickloom.llm.common import fold
from clickloom.session import scratch_path
from .conftest import edge_rows, tuples, words


def split(text, lower=False):
    b = (text or "").encode()
    return (b.lower() if lower else b).split()


def shingle_set(text):
    w = split(text, True)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    sets = {r[0]: shingle_set(r[1]) for r in rows if r[0] is not None}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(edge, none):
    rows = edge_rows()
    root = brute_classes(rows)
    want = [(r[0], len(shingle_set(r[1])), root.get(r[0]), r[0] is None or root[r[0]] == r[0]) for r in rows]
    got = tuples(neardup.near_duplicates(edge), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(want, key=repr)
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """Links between blocks of an oversized bucket are found; chains join by their links."""
    monkeypatch.setattr(neardup, "BUCKET", 3)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "WIDE", 7)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for k in range(30):  # each step changes a word: neighbours link, the ends of the chain don't
        base[(k * 37) % 100] = f"c{k}"
        rows.append((k, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    root = brute_classes(rows)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == root
    assert len(set(root.values())) < 10


def test_sketch_estimates_high_similarities():
    rng = np.random.default_rng(3)
    for j in (0.95, 0.85, 0.75):
        errors = []
        for _ in range(40):
            common = round(600 * 2 * j / (1 + j))
            pool = rng.integers(0, 1 << 63, 1200 - common, dtype=np.int64).view(np.uint64)
            a, b = pool[:600], np.concatenate([pool[:common], pool[600:]])
            s = neardup.odd_sketches(np.stack([neardup.minima(a), neardup.minima(b)])).view(np.uint64)
            z = np.bitwise_count(s[0] ^ s[1]).sum()
            assert z <= neardup.MAX_XOR
            errors.append(neardup.similarity_of_sketches(z) - j)
        assert abs(np.mean(errors)) < 0.03


def test_repeated_windows(edge, none, monkeypatch):
    rows = edge_rows()
    seen = Counter()
    for r in rows:
        w = split(r[1])
        seen.update(tuple(w[i:i + 35]) for i in range(len(w) - 34))
    want = []
    for r in rows:
        w = split(r[1])
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i:i + 35])] > 1:
                keep[i:i + 35] = [False] * 35
        kept = b" ".join(x for x, k in zip(w, keep) if k)
        want.append((r[0], len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()))
    got = tuples(substring.remove_repeats(edge), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(want, key=repr)
    assert sum(x[2] for x in got) > 0
    assert substring.remove_repeats(none).count() == 0
    out = substring.remove_repeats(edge, with_text=True).filter("n_removed > 0").collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 and sum(s.n for s in r.spans) == r.n_removed for r in out)


def test_hot_anchors_go_by_window(spark, monkeypatch):
    import random
    rng = random.Random(9)
    passage = words(rng, 50)
    docs = spark.createDataFrame([(i, words(rng, 40) + " " + passage + " " + words(rng, 40)) for i in range(30)], "doc_id long, text string")
    usual = tuples(substring.remove_repeats(docs), "doc_id", "n_removed", "kept_sha256")
    rows = docs.collect()
    files = substring.repeated_anchors(docs.select("text"), scratch_path(spark, "hot"), 35)
    # the same segments, all taken as hot: one window each
    hot = [w for r in rows for _, ws, mine in substring.documents([r.text.encode()], files, 35)
           for w in substring.segments(ws, [(a, f, n, 2) for a, f, n, _ in mine], 35)]
    count = Counter(t for _, t, _, _ in hot)
    marked = {t for t, m in count.items() if substring.marks_of({t: m}, 35)}
    removed = {i: n for i, n, _ in usual}
    for r in rows:
        ws = r.text.encode().split()
        drop = {j for k in range(len(ws) - 34) if b" ".join(ws[k:k + 35]) in marked for j in range(k, k + 35)}
        assert len(drop) == removed[r.doc_id]


def test_automaton_counts_places():
    a = substring.Automaton()
    texts = [b"x y x y x y".split(), b"y x y z".split()]
    for t in texts:
        a.add(t, 1)
    a.close()
    # windows of three: xyx yxy xyx yxy | yxy xyz
    assert [a.repeated(t, 3) for t in texts] == [0b1111, 0b01]


def test_contaminated(spark, edge, none):
    import random
    rng = random.Random(5)
    items = [(i, words(rng, n, 5000)) for i, n in enumerate([14, 15, 20, 33, 41, 59, 59])]
    items += [(7, None), (8, ""), (9, "three short words"), (10, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts, want = [], set()
    for d in range(60):
        i = d % 7
        w = items[i][1].split()
        how = d // 7
        if how == 1:
            w[0] = "edited"  # an edge word: one shingle less
        if how == 2 and len(w) == 59:
            w[30] = "edited"  # inside: five shingles of 55
        if how == 3:
            w = [x.upper() for x in w]
        if how >= 4:
            w = w[:len(w) // 2]
        texts.append((d, words(rng, 3 * d, 5000) + " " + " ".join(w) + " " + words(rng, 80 - d, 5000)))
    texts += [(100, "three SHORT words"), (101, "say three short words here"), (102, "one"), (103, None), (None, items[0][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    for d, t in texts:
        have = split(t, True)
        for i, item in items:
            need = split(item, True)
            if need and any(decontam.weighted_similarity(need, have[p:p + len(need)]) >= 0.75 for p in range(max(1, len(have) - len(need) + 1))):
                want.add((d, i))
    out = decontam.contaminated(docs, bench)
    got = {(r.doc_id, r.item_id) for r in out.collect()}
    assert got == want and len(want) > 30
    kept = decontam.clean(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in texts if d is not None and d not in {x for x, _ in want})
    assert decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontam.contaminated(edge, bench).columns == ["doc_id", "item_id", "similarity", "first_word"]


def test_items_less_their_last_words_are_found_at_any_layout():
    """Whole documents that are an item without its last or first words, between others of odd lengths."""
    import random
    rng = random.Random(12)
    items = [(i, words(rng, n, 5000).encode()) for i, n in enumerate([5, 8, 9, 15, 16, 20, 30, 45, 59, 100, 200])]
    index, word = decontam.Index(items), decontam.WordHash()
    for layout in range(4):
        lists, want = [], set()
        for i, t in items:
            w = t.split()
            for k in range(len(w) // 4 + 1):
                for have in (w[:len(w) - k], w[k:], words(rng, 70, 5000).encode().split() + w[:len(w) - k]):
                    lists.append(words(rng, rng.randrange(layout * 9 + 1), 5000).encode().split())
                    if max(decontam.weighted_similarity(w, have[p:p + len(w)]) for p in range(max(1, len(have) - len(w) + 1))) >= 0.75:
                        want.add((len(lists), i))
                    lists.append(have)
        got = {(d, i) for d, i, _, _ in index.hits(word, lists, 0.75)}
        assert want <= got and len(want) > 100
        assert got == want


@pytest.mark.parametrize("n, stretch", [(100, 9), (200, 24)])
def test_items_with_a_replaced_stretch_are_found(n, stretch):
    """At similarity 0.75 to 0.8, inside long documents; nearly all: a fingerprint is a sample."""
    import random
    rng = random.Random(n)
    items = [(i, words(rng, n, 50_000).encode()) for i in range(200)]
    lists, want = [], set()
    for i, t in items:
        w, a = t.split(), (n - stretch) // 2 if i % 2 else rng.randrange(n - stretch + 1)
        w[a:a + stretch] = words(rng, stretch, 50_000).encode().split()
        if decontam.weighted_similarity(t.split(), w) >= 0.75:
            want.add((len(lists), i))
        lists.append(words(rng, 200 + i, 50_000).encode().split() + w + words(rng, 300, 50_000).encode().split())
    got = {(d, i) for d, i, _, _ in decontam.Index(items).hits(decontam.WordHash(), lists, 0.75)}
    assert len(want & got) >= 0.98 * len(want) and len(want) > 180


def test_benchmark_in_slices(spark, monkeypatch):
    import random
    rng = random.Random(6)
    items = [(i, words(rng, 40, 3000)) for i in range(20)]
    docs = spark.createDataFrame([(i, words(rng, 50, 3000) + " " + t) for i, t in items], "doc_id long, text string")
    monkeypatch.setattr(decontam, "SLICE_BYTES", 1500)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert tuples(decontam.contaminated(docs, bench), "doc_id", "item_id") == [(i, i) for i in sorted(range(20), key=lambda x: repr((x, x)))]
    assert decontam.clean(docs, bench).count() == 0


def test_index_finds_all_pairs_within_the_radius():
    rng = np.random.default_rng(7)
    index = decontam.Index([(0, b" ".join(b"w%d" % i for i in range(40)))])
    (_, _, f, _, tables), = index.classes
    prints = np.concatenate([f[:1] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False))) for n in range(20) for _ in range(50)])
    w, i = index.candidates(prints, f, tables)
    near = {(a, b) for a in range(len(prints)) for b in range(len(f)) if int(prints[a] ^ f[b]).bit_count() <= decontam.RADIUS}
    assert set(zip(w.tolist(), i.tolist())) == near


def kn_brute(train, texts):
    uni, pairs = Counter(), Counter()
    for w in train:
        uni.update([*w, "</s>"])
        pairs.update(zip(["<s>", *w], [*w, "</s>"]))
    n, v = sum(uni.values()), len(uni)
    cont, ctx, ns = Counter(b for _, b in pairs), Counter(), defaultdict(lambda: [0, 0, 0])
    for (a, _), c in pairs.items():
        ctx[a] += c
    for (a, _), c in pairs.items():
        ns[a][min(c, 3) - 1] += 1
    cc = lambda x: [sum(1 for c in x.values() if c == k) for k in (1, 2, 3, 4)]
    d, e = kneser_ney.discounts(cc(pairs)), kneser_ney.discounts(cc(cont))
    total = len(pairs)
    m = sum(e[min(c, 3) - 1] for c in cont.values()) / total if total else 1.0

    def low(w):
        return (max(cont[w] - e[min(cont[w], 3) - 1], 0) / total if cont[w] else 0) + m / (v + 1)

    def p(w, h):
        if not ctx[h]:
            return low(w)
        c = pairs[h, w]
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / ctx[h] + sum(x * y for x, y in zip(d, ns[h])) / ctx[h] * low(w)
    out = []
    for w in texts:
        t = [*w, "</s>"]
        out.append((len(t), sum(uni[x] > 0 for x in t), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in t),
                    sum(math.log10(p(b, a)) for a, b in zip(["<s>", *w], t))))
    return out, (lambda h: sum(p(w, h) for w in uni) + p("\0", h))


def test_language_model(edge, none):
    rows = edge_rows()
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    lists = [split(r[1], True) for r in rows]
    want, mass = kn_brute([w for w, h in zip(lists, held) if not h], lists)
    assert mass("<s>") == pytest.approx(1) and mass(lists[0][0]) == pytest.approx(1)
    got = sorted(kneser_ney.lm_scores(edge, fold("doc_id", 7) == 2).collect(), key=lambda r: (repr(r.doc_id), r.n_tokens, r.score))
    want = sorted(((r[0], h, *w) for r, h, w in zip(rows, held, want)), key=lambda r: (repr(r[0]), r[2], r[6]))
    for g, w in zip(got, want, strict=True):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert g.base_score == pytest.approx(w[5]) and g.score == pytest.approx(w[6])
    assert kneser_ney.lm_scores(none, fold("doc_id", 7) == 2).count() == 0
    nothing = kneser_ney.lm_scores(edge.filter("doc_id = 3"), F.lit(True)).first()
    assert nothing.train_tokens == 0 and nothing.score == 0


def test_hot_words_are_dealt_by_word(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", 10)
    monkeypatch.setattr(kneser_ney, "HELD", 50)
    texts = [(i, " ".join(f"the w{(i * j) % 17}" for j in range(20))) for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    lists = [split(t) for _, t in texts]
    want, _ = kn_brute(lists, lists)
    got = {r.doc_id: r.score for r in kneser_ney.lm_scores(df, F.lit(False)).collect()}
    assert [got[i] for i in range(30)] == pytest.approx([w[4] for w in want])


def test_language_id(spark, edge, none):
    out = langid.identify(edge, fold("doc_id", 4) == 2).collect()
    rows = edge_rows()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in out:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
        if r.doc_id is not None and not any(c.isalpha() for c in text[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
    assert langid.identify(none, fold("doc_id", 4) == 2).count() == 0
    # unseen words fall back to their characters
    train = [(i, "katze hund maus haus " * 5, "de") for i in range(20)] + [(100 + i, "gatto cane topo casa " * 5, "it") for i in range(20)]
    docs = spark.createDataFrame([*train, (500, "katzen hauses", None), (501, "gatti casale", None), (502, "hund", None), (503, None, "de")],
                                 "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, F.col("doc_id") >= 500).collect()}
    assert [got[i] for i in (500, 501, 502, 503)] == ["de", "it", "de", "und"]


def test_quality(spark, edge, none):
    import random
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(400):
        good = i % 5 > 0
        t = words(rng, rng.randrange(5, 60))
        docs.append((i, t if good else t.upper().replace(" ", "!! ")))
        labels.append((i, int(good)))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    out = quality.classify(d, marks, fold("doc_id", 3) == 1).collect()
    assert len(out) == 400 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == (r.doc_id % 5 > 0) for r in held) / len(held) > 0.97
    kept = quality.keep_good(d, marks)
    assert kept.columns == d.columns and abs(kept.count() - 320) <= 8
    assert quality.classify(edge, marks, fold("doc_id", 3) == 1).count() == edge.count()
    assert quality.classify(none, marks, F.lit(False)).count() == 0
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.predicted for r in quality.classify(d, no_labels, F.lit(False)).collect()} == {1}


def test_repeated_labelled_ids_teach_once(spark, monkeypatch):
    docs = spark.createDataFrame([(0, f"same id {i:03d}") for i in range(300)] + [(0, None)] + [(i, f"text {i}") for i in range(1, 20)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(quality, "fit_pairs", lambda x, good: seen.update(x=x, good=good))
    quality.fit(docs, marks)
    assert len(seen["x"]) == 20 and seen["good"].sum() == 10
    want = sorted(quality.features(t).tolist() for t in [b"same id 000", *(b"text %d" % i for i in range(1, 20))])
    assert sorted(seen["x"].tolist()) == want


def test_pairs_order_documents():
    x = np.zeros((60, quality.N_FEATURES))
    x[:, 0] = np.arange(60)
    good = np.arange(60) >= 20
    m = quality.fit_pairs(x, good)
    worth = ((x - m["mean"]) / m["sd"]) @ m["w"]
    assert ((worth >= m["threshold"]) == good).mean() > 0.95 and (np.diff(worth) > 0).all()


def test_token_files(spark, edge, none):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(token_files.default_tokenizer())
    rows = sorted(edge_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start, stream = [], 0, []
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        stream += ids
    files = token_files.write_sequences(edge, scratch_path(spark, "tokens"), seq_len=64)
    got = sorted((tuple(r)[:4] for r in token_files.read_documents(files).collect()), key=lambda r: r[1])
    assert got == want
    back = []
    for f in files.orderBy("part").collect():  # random access, sequence by sequence
        s = token_files.SequenceFile(f.path)
        n = -(-f.n_tokens // 64)
        for i in range(n):
            ids, mask = s[i]
            assert len(ids) == len(mask) == 64 and not ids.flags.owndata
            back += ids[mask].tolist()
    assert back == stream
    assert token_files.token_documents(none).count() == 0
