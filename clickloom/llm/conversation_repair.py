"""Repair of conversations by a cheapest sequence of edits.

A whole conversation's role initials are ``(s?(ua)+)?``.  Each row is kept, given another role, or deleted, and empty
rows may be inserted before it; the wanted sequence is the cheapest, among equals the one whose edits' initials are
ASCII-least.  It is found by iterative-deepening A*: a depth-first search in the order D, I, K, R under a cost bound
that rises to the least cost it was exceeded by; a table keeps what every failed state (row, place in the pattern)
is known to cost at least, so no state is searched twice with as little left to spend.  The first path accepted is
the answer, and edits fix their own place in the pattern, so it is the only one with its initials.

Conversations may be of any length.  Rows are range-sorted by conversation and turn, and each range becomes an Arrow
file in the shared folder; texts move once.  Repeated rows are found by hash over row addresses.  A conversation that
lies in several files is a chain of pieces: each piece gives its 4 x 4 table of least costs (place at entry, place at
exit), the tables, one or two a file, are chained in one small task, and every piece is then searched with the cost of
all that follows as the price of its exits.  Inside a piece the same is done for stretches of ``STRETCH`` rows.  So no
task sees more rows than a file has, and results don't depend on where files or stretches end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from clickloom.llm.common import materialize, stored
from clickloom.llm.files import create, open_file
from clickloom.session import scratch_path

#: Rows searched at once; longer pieces go by stretches.
DIRECT, STRETCH = 48, 16
#: Rows of a file's Arrow batches, and bytes hashed at a time.
BATCH, BLOCK = 2048, 1 << 20

#: The costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

NONE, BLANK, DUPLICATE, CUT = range(4)
OTHER, SYSTEM, USER, ASSISTANT = range(4)
#: Places in the pattern: nothing yet, after s, after u, after a; and what may be kept at each: {place: {initial: next place}}.
KEEP = [{SYSTEM: 1, USER: 2}, {USER: 2}, {ASSISTANT: 3}, {USER: 2}]
#: Where a new role leads from each place, and which role that is.
NEXT = [2, 2, 3, 2]
ROLE = ["user", "user", "assistant", "user"]
NEVER = 1 << 60
#: What the empty rows cost that complete the pattern behind the last row, by place.
END = [0, 2 * INSERT, INSERT, 0]
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}

WORDY = re.compile(r"[^\x20\x09-\x0D]")
LAST = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


class Edit(NamedTuple):
    initial: str
    row: int
    role: str | None


def fault_of(text: str) -> int:
    return BLANK if not WORDY.search(text) else NONE if LAST.search(text) else CUT


def choices(mark: int, place: int) -> list[tuple[str, int, int, int]]:
    """Edits of a row (``initial + 4 * fault``) at a place, in ASCII order: (initial, cost, rows used, next place)."""
    initial, fault = mark & 3, mark >> 2
    out = [("D", DELETE, 1, place), ("I", INSERT, 0, NEXT[place])]
    if fault in (NONE, CUT):
        extra = TRUNCATED if fault == CUT else 0
        if initial in KEEP[place]:
            out.append(("K", extra, 1, KEEP[place][initial]))
        out.append(("R", REROLE + extra, 1, NEXT[place]))
    return out


CHOICES = [[choices(mark, place) for place in range(4)] for mark in range(16)]
#: The least that a row costs, wherever it stands.
LEAST = [min(cost for place in range(4) for kind, cost, _, _ in CHOICES[mark][place] if kind != "I") for mark in range(16)]


def search(marks: bytes, entry: int, after: list[int], known: list[list[int]] | None = None) -> tuple[int, str, int]:
    """The cheapest edits of some rows from the place ``entry``, if leaving at place p costs ``after[p]``:
    (cost, what follows included; initials; place left at).  ``known`` keeps what searches with the same
    ``after`` have learned."""
    n = len(marks)
    if known is None:
        known = table(marks, after)
    if known[0][entry] >= NEVER:
        return NEVER, "", entry
    path: list[str] = []
    at = entry

    def walk(i: int, place: int, left: int) -> bool:
        nonlocal at
        here = known[i]
        if here[place] > left:
            return False
        if i == n:  # known is exact here
            at = place
            return True
        least = NEVER
        for initial, cost, used, then in CHOICES[marks[i]][place]:
            learned = known[i + used]
            if cost + learned[then] <= left:
                path.append(initial)
                if walk(i + used, then, left - cost):
                    return True
                path.pop()
            least = min(least, cost + learned[then])
        here[place] = max(here[place], least)
        return False

    while True:
        bound = known[0][entry]
        if walk(0, entry, bound):
            return bound, "".join(path), at


def table(marks: bytes, after: list[int]) -> list[list[int]]:
    """For each row and place the cost of all that follows, as far as it is known before any search: never too much."""
    n = len(marks)
    out = [[0] * 4 for _ in range(n)] + [list(after)]
    ahead, system = 0, False
    for i in range(n - 1, -1, -1):
        ahead += LEAST[marks[i]]
        system = system or (marks[i] & 3 == SYSTEM and marks[i] >> 2 in (NONE, CUT))
        for place in range(4):
            # places that can be left at from here; u and a always can
            ways = [after[2], after[3]] + [after[place]] + ([after[1]] if place == 0 and system else [])
            price = min(ways)
            out[i][place] = NEVER if price >= NEVER else ahead + price
    return out


def prices(marks: bytes, after: list[int]) -> list[list[int]]:
    """The exact cost of all that follows from the beginning of each stretch, by place; ``after`` at the end."""
    out = [after]
    for at in reversed(range(0, len(marks), STRETCH)):
        part = marks[at:at + STRETCH]
        known = table(part, out[-1])
        out.append([search(part, place, out[-1], known)[0] for place in range(4)])
    return out[::-1]


def solve(marks: bytes, entry: int, after: list[int]) -> tuple[str, int]:
    """Initials of the cheapest edits of a piece, and the place that it is left at."""
    if len(marks) <= DIRECT:
        _, initials, place = search(marks, entry, after)
        return initials, place
    ahead, found, place = prices(marks, after), [], entry
    for k, at in enumerate(range(0, len(marks), STRETCH)):
        _, initials, place = search(marks[at:at + STRETCH], place, ahead[k + 1])
        found.append(initials)
    return "".join(found), place


def cost_table(marks: bytes) -> list[int]:
    """Least costs of a piece: entry 4 * p + exit q."""
    columns = [prices(marks, [0 if p == q else NEVER for p in range(4)])[0] for q in range(4)]
    return [columns[q][p] for p in range(4) for q in range(4)]


def edits(marks: bytes, initials: str, entry: int) -> Iterator[Edit]:
    """The edits behind the initials, with the role that each leaves (None: the row's own, or no row)."""
    row, place = 0, entry
    for x in initials:
        if x == "D":
            yield Edit(x, row, None)
        elif x == "K":
            yield Edit(x, row, None)
            place = KEEP[place][marks[row] & 3]
        else:
            yield Edit(x, row, ROLE[place])
            place = NEXT[place]
        row += x != "I"


def cost_of(marks: bytes, initials: str) -> int:
    total, row = 0, 0
    for x in initials:
        if x == "I":
            total += INSERT
            continue
        cut = TRUNCATED if marks[row] >> 2 == CUT else 0
        total += DELETE if x == "D" else REROLE + cut if x == "R" else cut
        row += 1
    return total


# --- files of sorted rows -------------------------------------------------------------------------------------------

ROWS = pa.schema([("conv_id", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def write_rows(rows: DataFrame) -> tuple[DataFrame, str]:
    """Range-sorted Arrow files of the rows; one row per row, its address and what it says: ``part, idx, conv_id, key, mark, path``
    (``key``: hash of role and text, null for a blank one; ``path``: on the first row of a file)."""
    folder = scratch_path(rows.sparkSession, "turns")
    order = ["conv_id", "turn", "tie", "copy"]
    keyed = (rows.withColumn("tie", F.xxhash64("role", "text"))
             # equal rows are interchangeable; their places in the input part them, however many they are
             .withColumn("copy", F.monotonically_increasing_id()))
    keyed = keyed.repartitionByRange(*order).sortWithinPartitions("conv_id", "turn", "tie", "role", "text", "copy").select("conv_id", "role", "text")

    def write(batches):
        out = stream = None
        at, part, path = 0, TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            first = out is None
            if first:
                path, stream = create(folder, f"rows-{part:05d}")
                out = pa.ipc.new_file(stream, ROWS)
            batch = pa.record_batch([batch.column(f.name).cast(f.type) for f in ROWS], schema=ROWS)
            marks, keys = [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                fault = fault_of(text)
                marks.append(INITIALS.get(role[:1], OTHER) | fault << 2)
                r = role.encode()
                keys.append(None if fault == BLANK else xxhash.xxh3_128_digest(len(r).to_bytes(8, "little") + r + text.encode()))
            for k in range(0, batch.num_rows, BATCH):
                out.write_batch(batch.slice(k, BATCH))
            n = batch.num_rows
            yield pa.record_batch({"part": pa.array(np.full(n, part, np.int64)), "idx": pa.array(np.arange(at, at + n)),
                                   "conv_id": batch.column("conv_id"), "key": pa.array(keys, pa.binary()),
                                   "mark": pa.array(marks, pa.int32()), "path": pa.array([path if first else None] + [None] * (n - 1), pa.string())})
            at += n
        if out is not None:
            out.close()
            stream.close()

    return stored(keyed.mapInArrow(write, "part long, idx long, conv_id long, key binary, mark int, path string"), "addresses")


def runs_of(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Where each run of one conversation begins, and the end."""
    new = np.flatnonzero((ids[1:] != ids[:-1]) | (null[1:] != null[:-1])) + 1
    return np.concatenate([[0], new, [len(ids)]])


def mark_files(addresses: DataFrame) -> DataFrame:
    """One row a file: paths of its rows and of its marks (a byte a row, repeats found), its first and last
    conversation, how many rows they have there and their cost tables."""
    folder = scratch_path(addresses.sparkSession, "marks")
    known = addresses.filter(F.col("key").isNotNull()).select("part", "idx", "conv_id", "key")
    first = known.groupBy("conv_id", "key").agg(F.min(F.struct("part", "idx")).alias("a")).select("a.part", "a.idx")
    again = known.select("part", "idx").join(first, ["part", "idx"], "left_anti").select("part", "idx", F.lit(True).alias("again"))
    # the marks of a file's rows: as many as one task of the sort had
    rows = (addresses.select("part", "idx", "conv_id", "mark", "path").join(again, ["part", "idx"], "left")
            .select("part", "idx", "conv_id", F.when(F.col("again"), F.col("mark").bitwiseAND(3) + 4 * DUPLICATE).otherwise(F.col("mark")).alias("mark"), "path"))

    def mark(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        marks = t.column("mark").to_numpy().astype(np.uint8)
        conv = t.column("conv_id").combine_chunks()
        null = conv.is_null().to_numpy(zero_copy_only=False)
        starts = runs_of(conv.fill_null(0).to_numpy(zero_copy_only=False), null)
        part = t.column("part")[0].as_py()
        path, stream = create(folder, f"marks-{part:05d}")
        stream.write(marks.tobytes())
        stream.close()
        n_first, n_last = int(starts[1]), int(starts[-1] - starts[-2])
        raw = marks.tobytes()
        only = len(starts) == 2
        head = cost_table(raw[:n_first])
        return pa.table({"part": [part], "path": [t.column("path")[0].as_py()], "marks": [path],
                         "first": pa.array([conv[0].as_py()], pa.int64()), "last": pa.array([conv[-1].as_py()], pa.int64()),
                         "n_first": [n_first], "n_last": [n_last], "only": [only],
                         "head": [head], "tail": [head if only else cost_table(raw[-n_last:])]})

    return materialize(rows.groupBy("part").applyInArrow(mark, "part long, path string, marks string, first long, last long, n_first long, "
                                                               "n_last long, only boolean, head array<long>, tail array<long>"))


def chains(files: list[dict]) -> list[list[tuple[int, str]]]:
    """Pieces (file, head or tail) that belong to one conversation, for those in several files.  A file that holds one
    conversation alone is its head only."""
    out: list[list[tuple[int, str]]] = []
    for k, f in enumerate(files):
        if k and out and out[-1] and files[k - 1]["last"] == f["first"]:
            out[-1].append((k, "head"))
        else:
            out.append([(k, "head")])
        if not f["only"]:
            out.append([(k, "tail")])
    return [c for c in out if len(c) > 1]


def priced(files: list[dict]) -> list[dict]:
    """``files`` with the price of what follows their pieces: ``head_after``, ``tail_after`` (None: not part of a chain), and
    ``goes_on``: the last conversation does, in the next file."""
    for f in files:
        f["head_after"], f["tail_after"], f["goes_on"] = None, None, False
    for chain in chains(files):
        after = list(END)
        for k, _ in chain[:-1]:
            files[k]["goes_on"] = True
        for k, end in reversed(chain):
            files[k][end + "_after"] = after
            costs = files[k][end]
            after = [min(costs[4 * p + q] + after[q] for q in range(4)) for p in range(4)]
    return files


def entered(files: list[dict]) -> list[dict]:
    """``files`` with the places at which their pieces are entered: ``head_entry``, ``tail_entry``."""
    for f in files:
        f["head_entry"] = f["tail_entry"] = 0
    for chain in chains(files):
        place = 0
        for k, end in chain:
            files[k][end + "_entry"] = place
            place = files[k][end + "_exit"][place]
    return files


def in_order(files: DataFrame, fill, columns: str) -> DataFrame:
    """``fill`` over the table of files in order, in one task: a few hundred bytes a file."""
    kept = files.columns

    def run(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["part"])
        if rows:
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in fill(rows)], schema)

    types = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
             "string": pa.string(), "boolean": pa.bool_()}
    fields = [(f.name, f.dataType.simpleString().replace("bigint", "long")) for f in files.schema] + [tuple(c.split()) for c in columns.split(", ")]
    names = [*kept, *(c.split()[0] for c in columns.split(", "))]
    schema = pa.schema([(n, types[t]) for n, t in fields])
    return files.repartition(1).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields))


def marks_of(f: dict) -> bytes:
    with open_file(f["marks"]) as file:
        return file.read()


def exits(files: DataFrame, n_files: int) -> DataFrame:
    """For every piece of a chain, where it is left for each place of entry: ``head_exit``, ``tail_exit``."""

    def run(batches):
        for batch in batches:
            out = []
            for f in batch.to_pylist():
                raw = marks_of(f) if f["head_after"] or f["tail_after"] else b""
                f["head_exit"] = f["tail_exit"] = None
                if f["head_after"]:
                    f["head_exit"] = [solve(raw[:f["n_first"]], p, f["head_after"])[1] for p in range(4)]
                if f["tail_after"]:
                    f["tail_exit"] = [solve(raw[-f["n_last"]:], p, f["tail_after"])[1] for p in range(4)]
                out.append(f)
            yield pa.RecordBatch.from_pylist(out, pa.schema([*batch.schema, ("head_exit", pa.list_(pa.int32())), ("tail_exit", pa.list_(pa.int32()))]))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema) + ", head_exit array<int>, tail_exit array<int>"
    return files.repartition(max(1, n_files), "part").mapInArrow(run, schema)


class Piece(NamedTuple):
    conv_id: int | None
    order: int  # of the pieces of a conversation
    whole: bool
    marks: bytes
    initials: str
    entry: int


def pieces_of(f: dict) -> Iterator[tuple[Piece, Iterator[tuple[str, str]]]]:
    """Every conversation, or piece of one, of a file with its edits and its rows (role, text), in order."""
    raw = marks_of(f)
    reader = pa.ipc.open_file(open_file(f["path"]))
    batches = [reader.get_batch(b).column("conv_id") for b in range(reader.num_record_batches)]
    conv = pa.chunked_array(batches, pa.int64()).combine_chunks()
    starts = runs_of(conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False))

    def rows() -> Iterator[tuple[str, str]]:
        for b in range(reader.num_record_batches):
            batch = reader.get_batch(b)
            yield from zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())

    stream = rows()
    for k in range(len(starts) - 1):
        lo, hi = int(starts[k]), int(starts[k + 1])
        end = "head" if k == 0 else "tail" if k == len(starts) - 2 else ""
        after = f[end + "_after"] if end else None
        entry = f[end + "_entry"] if end else 0
        marks = raw[lo:hi]
        initials, place = solve(marks, entry, after or END)
        if not (f["goes_on"] and k == len(starts) - 2):
            initials += "I" * (END[place] // INSERT)
        yield Piece(conv[lo].as_py(), f["part"], after is None, marks, initials, entry), (next(stream) for _ in range(hi - lo))


def repaired(piece: Piece, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The rows that a piece's edits leave."""
    held = -1
    row = ("", "")
    for e in edits(piece.marks, piece.initials, piece.entry):
        if e.initial == "I":
            yield e.role, ""
            continue
        while held < e.row:
            row, held = next(rows), held + 1
        if e.initial != "D":
            yield e.role or row[0], row[1]


def plan(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Sort the rows into files and settle the places and prices of pieces that cross files: (files, how many)."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        space(role_col).alias("role"), space(text_col).alias("text"))
    addresses, _ = write_rows(rows)
    files = mark_files(addresses)
    n = files.count()
    files = in_order(files, priced, "head_after array<long>, tail_after array<long>, goes_on boolean")
    files = in_order(exits(files, n), entered, "head_entry int, tail_entry int")
    return materialize(files), n


RESULT = ("conv_id long, piece long, whole boolean, blank long, duplicate long, truncated long, illegal long, initial int, final int, "
          "cost long, audit string, n_repaired long, sha256 string, path string")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, blank, duplicate, truncated, illegal`` (faults before repair), ``cost, audit,
    n_repaired, repaired_sha256`` (of ``role:text`` joined by newlines).  ``repaired_rows`` gives the rows themselves.

    A null role or text is one space; a null conversation id is a conversation, a null turn comes first.  Rows of
    one turn come in the order of a hash of role and text, so equal rows are neighbours.  A row whose role is empty
    or begins with another letter can't be kept.  Other columns aren't read; an empty table gives no rows.
    """
    files, n = plan(turns, conv_col, turn_col, role_col, text_col)
    folder = scratch_path(turns.sparkSession, "repaired")

    def run(batches):
        for batch in batches:
            for f in batch.to_pylist():
                held = []
                for piece, rows in pieces_of(f):
                    held.append(digest(piece, rows, folder))
                    if len(held) >= 1000 or not piece.whole:
                        yield pa.RecordBatch.from_pylist(held, SCHEMA)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, SCHEMA)

    found, _ = stored(files.repartition(max(1, n), "part").mapInArrow(run, RESULT), "conversations")
    columns = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "n_repaired"]
    one = found.filter("whole").select(*columns, F.col("sha256").alias("repaired_sha256"))
    # the pieces of conversations in several files: one row a piece
    several = found.filter("NOT whole").groupBy("conv_id").applyInArrow(
        joined, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, n_repaired long, repaired_sha256 string")
    return one.unionByName(several)


SCHEMA = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}[t]) for n, t in
                    (c.split() for c in RESULT.split(", "))])
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def digest(piece: Piece, rows: Iterator[tuple[str, str]], folder: str) -> dict:
    """A conversation's figures; for a piece of one, its text goes to a file to be hashed with the others."""
    m = np.frombuffer(piece.marks, np.uint8)
    initials, faults = m & 3, np.bincount(m >> 2, minlength=4)
    legal = sum(int(((initials[:-1] == a) & (initials[1:] == b)).sum()) for a, b in LEGAL)
    sha, n, path, stream = hashlib.sha256(), 0, None, None
    if not piece.whole:
        path, stream = create(folder, f"piece-{piece.order:05d}")
    put = sha.update if stream is None else stream.write
    for role, text in repaired(piece, rows):
        put((("\n" if n else "") + f"{role}:{text}").encode())
        n += 1
    for _ in rows:  # what was deleted at the end
        pass
    if stream is not None:
        stream.close()
    return {"conv_id": piece.conv_id, "piece": piece.order, "whole": piece.whole, "blank": int(faults[BLANK]), "duplicate": int(faults[DUPLICATE]),
            "truncated": int(faults[CUT]), "illegal": len(m) - 1 - legal, "initial": int(initials[0]), "final": int(initials[-1]),
            "cost": cost_of(piece.marks, piece.initials), "audit": piece.initials, "n_repaired": n,
            "sha256": sha.hexdigest() if piece.whole else None, "path": path}


def joined(t: pa.Table) -> pa.Table:
    """The pieces of one conversation: their texts are read block by block, in order, into one hash."""
    rows = t.sort_by("piece").to_pylist()
    sha, some = hashlib.sha256(), False
    for r in rows:
        if r["n_repaired"]:
            if some:
                sha.update(b"\n")
            some = True
            with open_file(r["path"]) as f:
                while block := f.read(BLOCK):
                    sha.update(block)
    illegal = sum(r["illegal"] for r in rows) + sum((a["final"], b["initial"]) not in LEGAL for a, b in zip(rows, rows[1:]))
    total = lambda c: sum(r[c] for r in rows)
    return pa.table({"conv_id": pa.array([rows[0]["conv_id"]], pa.int64()), "blank": [total("blank")], "duplicate": [total("duplicate")],
                     "truncated": [total("truncated")], "illegal": [illegal], "cost": [total("cost")], "audit": ["".join(r["audit"] for r in rows)],
                     "n_repaired": [total("n_repaired")], "repaired_sha256": [sha.hexdigest()]})


def repaired_rows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: ``conv_id, piece, nth, role, text``; rows of a conversation in the order of (piece, nth)."""
    files, n = plan(turns, conv_col, turn_col, role_col, text_col)
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("nth", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            for f in batch.to_pylist():
                held = []
                for piece, rows in pieces_of(f):
                    for nth, (role, text) in enumerate(repaired(piece, rows)):
                        held.append((piece.conv_id, piece.order, nth, role, text))
                        if len(held) >= BATCH:
                            yield pa.record_batch([pa.array(c, x.type) for c, x in zip(zip(*held), schema)], schema=schema)
                            held = []
                    for _ in rows:
                        pass
                if held:
                    yield pa.record_batch([pa.array(c, x.type) for c, x in zip(zip(*held), schema)], schema=schema)

    return files.repartition(max(1, n), "part").mapInArrow(run, "conv_id long, piece long, nth long, role string, text string")


# --- the damage that the query repairs -------------------------------------------------------------------------------

def fate() -> Column:
    """What happens to a row: crc32 of ``conv_id:turn`` modulo 20."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 sets the role user; nulls are one space."""
    f = F.col("fate")
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("fate", fate()).filter(f != 0)
    return (rows.withColumn("role", F.when(f == 4, "user").otherwise(role))
            .withColumn("text", F.when(f == 1, "").when(f == 2, F.translate(text, ".!?", "")).otherwise(text))
            .withColumn("copy", F.explode(F.when(f == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
            .select("conv_id", "turn", "role", "text"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The digest of the repaired damaged conversations, one row for every original ``conv_id``."""
    turn = F.when(fate() != 0, F.col("turn"))
    every = conversations.groupBy("conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps"))
    done = repair(damaged(conversations)).withColumnRenamed("conv_id", "key")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return (every.join(done, F.col("conv_id").eqNullSafe(F.col("key")), "left")
            .select("conv_id", F.col("gaps").cast("long").alias("gaps"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))
