"""Conversation repair against a plain dynamic program over the same rules."""
import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

from clickloom.llm import conversation_repair as cr
from .conftest import tuples

sys.setrecursionlimit(20_000)
SPACES = "\x20\x09-\x0d"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = re.sub(f"[{SPACES}]+$", "", text)
        out.append("blank" if not bare.strip("\x20\x09\x0a\x0b\x0c\x0d") else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def best(rows, faults):
    """(cost, initials, repaired rows): the least cost, then the ASCII-least initials, by trying every edit of every
    row at every place of the pattern."""
    @lru_cache(None)
    def go(i, done, inserts):
        """done: role initials so far, as the pattern has them."""
        found = []
        if i == len(rows) and done in ("", "a"):
            found.append((0, "", ()))
        roles = {"": ["user"], "s": ["user"], "u": ["assistant"], "a": ["user"]}[done]
        if inserts < 4:
            for role in roles:
                c, x, out = go(i, role[0], inserts + 1)
                found.append((c + 5, "I" + x, ((role, ""), *out)))
        if i < len(rows):
            role, text = rows[i]
            c, x, out = go(i + 1, done, 0)
            found.append((c + 2, "D" + x, out))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                if role[:1] and role[0] in {"": "su", "s": "u", "u": "a", "a": "u"}[done]:
                    c, x, out = go(i + 1, role[0], 0)
                    found.append((c + extra, "K" + x, ((role, text), *out)))
                for new in roles:
                    c, x, out = go(i + 1, new[0], 0)
                    found.append((c + extra + 1, "R" + x, ((new, text), *out)))
        return min(found, default=(10 ** 9, "", ()), key=lambda f: f[:2])
    return go(0, "", 0)


def expected(table):
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        if fate == 0:
            continue
        if fate == 4:
            role = "user"
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        rows += [(turn, role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [t for t, _, _ in rows if t is not None]
        said = [(r, t) for _, r, t in rows]
        faults = faults_of(said)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
        cost, audit, kept = best(tuple(said), tuple(faults))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha))
    return sorted(out, key=repr)


def conversations(seed, n, longest, turns_unique=True):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "Sys", "sage", ""])
            if rng.random() < 0.7:
                role = "user" if turn % 2 == 0 else "assistant"
            text = rng.choice(["Yes.", "No", "Really?\n", "", " \t", "Ok!", None, f"text {turn}.", f"cut {turn}", "odd \x1c", "é.", "a:b\nc."])
            rows.append((conv, turn, role, text))
    rows += [(None, 0, "user", "no conversation."), (None, None, "assistant", "first, as its turn is null."), (500, None, "user", "alone."),
             (501, 3, "assistant", "x" * 50_000 + "."), (502, -5, "user", "negative."), (502, 7, "assistant", "far.")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA + ", part string, mark string, key string, idx string") if rows and len(rows[0]) > 4 else spark.createDataFrame(rows, SCHEMA)
    return tuples(cr.repair_damaged(df.repartition(parts)), *COLUMNS)


def test_equals_brute_force(spark):
    rows = conversations(1, 120, 9)
    clashing = [(*r, "a", "b", "c", "d") for r in rows]
    assert run(spark, clashing) == expected(rows)


def test_long_conversations_in_files_and_stretches(spark, monkeypatch):
    rows = conversations(2, 4, 160) + [(9, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(300)]
    want = expected(rows)
    assert any(len(r[7]) > 250 for r in want)
    assert run(spark, rows) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        monkeypatch.setattr(cr, "DIRECT", 6)
        monkeypatch.setattr(cr, "STRETCH", 3)
        files, n = cr.plan(cr.damaged(spark.createDataFrame(rows, SCHEMA)), "conv_id", "turn", "role", "text")
        assert n > 15 and files.filter("goes_on").count() > 10
        assert run(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_stretches_change_nothing(monkeypatch):
    rng = random.Random(3)
    cases = [bytes(rng.choice([1, 2, 2, 3, 3, 0, 4, 8, 14, 15, 6]) for _ in range(rng.randrange(1, 45))) for _ in range(150)]
    whole = [cr.solve(c, p, cr.END) for c in cases for p in range(4)]
    monkeypatch.setattr(cr, "DIRECT", 1)
    for stretch in (1, 2, 5, 16):
        monkeypatch.setattr(cr, "STRETCH", stretch)
        assert [cr.solve(c, p, cr.END) for c in cases for p in range(4)] == whole


def test_all_dropped_none_and_repeated(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    plain = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 > 4)
    assert run(spark, [(7, dropped, "user", "gone.")]) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert run(spark, []) == []
    rows = [(7, plain, "user", "again.")] * 40 + [(7, plain + 1, "assistant", "so.")] * 3
    assert run(spark, rows) == expected(rows)


def test_repaired_rows_are_what_the_digest_hashes(spark):
    rows = conversations(4, 30, 12)
    df = cr.damaged(spark.createDataFrame(rows, SCHEMA))
    said = {}
    for r in sorted(cr.repaired_rows(df).collect(), key=lambda r: (r.piece, r.nth)):
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in cr.repair(df).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(said.get(r.conv_id, [])).encode()).hexdigest()
        assert r.n_repaired == len(said.get(r.conv_id, []))
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in said.get(r.conv_id, [])))
