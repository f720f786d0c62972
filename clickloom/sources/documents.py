"""Whole recordings as ``<root>/<recording>/recording.json``, one document each.

No row and no task ever holds an event list.  A recording is a stream of rows (recording, section, position, JSON text):
its head, its notes, its events.  They are range-sorted, so a partition has whole recordings and at both ends a piece
of one that may go on in its neighbours.  ``RecordingDocuments``, a Spark data source, writes each whole recording
straight to its document and the pieces to part files; what a task tells the commit are its pieces, two at most.  The
commit writes down the list of pieces, and a small Spark job joins them block by block, one task a recording.  The
marker ``_committed`` comes last; a folder without it is of an unfinished write.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from clickloom import model
from clickloom.sources.files import NewFile, resolve

HEAD, NOTES, EVENTS = 0, 1, 2
#: Bytes of a piece copied at a time.
BLOCK = 1 << 22
MARKER = "_committed"
FRAGMENT = "rec string, section int, pos long, text string"


def event_json() -> Column:
    """An event as JSON, its nulls left out; ``value_json`` goes in as it is."""
    plain = F.to_json(F.struct("id", "ts_ms", "surface", "type", "target", "screenshot_path", "viewport", "redacted", "notes"))
    value = F.when(F.col("value_json").isNotNull(), F.concat(F.lit(',"value":'), F.col("value_json"))).otherwise(F.lit(""))
    return F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), value, F.lit("}"))


def fragments(events: DataFrame, envelopes: DataFrame, key: str = "rec_id") -> DataFrame:
    """The rows of the documents: ``rec, section, pos, text``.  Envelopes may have any of version, surface, started_at,
    ended_at, metadata and notes; a recording is written if it has an envelope, its events or none at all."""
    have = [c for c in ("surface", "started_at", "ended_at", "metadata") if c in envelopes.columns]
    version = F.coalesce("version", F.lit(model.SCHEMA_VERSION)) if "version" in envelopes.columns else F.lit(model.SCHEMA_VERSION)
    rec = F.col(key).cast("string").alias("rec")
    head = F.to_json(F.struct(version.alias("version"), *have))
    rows = envelopes.select(rec, F.lit(HEAD).alias("section"), F.lit(0).cast("long").alias("pos"),
                            F.substring(head, F.lit(1), F.length(head) - 1).alias("text"))
    if "notes" in envelopes.columns:
        notes = envelopes.select(rec, F.posexplode("notes").alias("at", "note"))
        rows = rows.unionByName(notes.select("rec", F.lit(NOTES).alias("section"), F.col("at").cast("long").alias("pos"), F.to_json("note").alias("text")))
    listed = events.join(envelopes.select(key), key, "left_semi")
    return rows.unionByName(listed.select(rec, F.lit(EVENTS).alias("section"), F.col("ord").cast("long").alias("pos"), event_json().alias("text")))


def joint(before: int | None, after: int | None) -> str:
    """What stands between two fragments, by their sections; None: the document's ends."""
    if before == after and before != HEAD:
        return ",\n"
    if after == HEAD or before is not None and after is not None and after < before:
        raise ValueError("a recording has two envelopes")
    out = "{" if before is None else ""
    at = HEAD if before is None else before
    comma = "" if before is None else ","
    if at < NOTES and after != HEAD:
        out, at, comma = out + comma + '"notes":[', NOTES, ","
    if at == NOTES and after != NOTES:
        out, at = out + '],"events":[\n', EVENTS
    return out + ("\n]}\n" if after is None else "")


def opening(section: int) -> str:
    return "" if section == HEAD else joint(None, section)


@dataclass
class Pieces(WriterCommitMessage):
    """What a task tells the commit: the pieces at the ends of its rows, and how many whole documents it wrote."""
    pieces: list
    documents: int


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, root: str, job: str):
        self.root, self.job = root, job

    def document(self, rec: str) -> str:
        return f"{self.root}/{urllib.parse.quote(rec, safe='')}/recording.json"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Pieces:
        out, pieces, documents = None, [], 0
        rec = first = last = None
        begins = False  # the first recording of the rows may have begun in the partition before

        def close(whole: bool) -> None:
            nonlocal documents
            if whole:
                out.write(joint(last[0], None))
                documents += 1
            else:
                pieces.append({"rec": rec, "section": first[0], "pos": first[1], "last": last[0], "path": out.path})
            out.publish()

        for batch in batches:
            for name, section, pos, text in zip(*(batch.column(c).to_pylist() for c in ("rec", "section", "pos", "text"))):
                if out is None or name != rec:
                    if out is not None:
                        close(begins)
                    rec, first, begins = name, (section, pos), section == HEAD
                    # a recording that begins here is written to its place; should it be the last, it is moved to be joined
                    path = self.document(rec) if begins else f"{self.root}/_parts/{self.job}/{uuid.uuid4().hex}"
                    out = NewFile(path)
                else:
                    out.write(joint(last[0], section))
                out.write(text)
                last = (section, pos)
        if out is not None:
            if begins:  # whether it ends here, the next partition knows
                out.path = f"{out.path.rpartition('/')[0].rpartition('/')[0]}/_parts/{self.job}/{uuid.uuid4().hex}"
                out.system.create_dir(out.path.rpartition("/")[0], recursive=True)
            close(False)
        return Pieces(pieces, documents)

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None]
        out = NewFile(f"{self.root}/_parts/{self.job}.json")
        for m in done:
            for piece in m.pieces:
                out.write(json.dumps(piece) + "\n")
        out.publish()

    def abort(self, messages) -> None:
        system, path = resolve(f"{self.root}/_parts/{self.job}")
        if system.get_file_info(path).type.name == "Directory":
            system.delete_dir(path)


class RecordingDocuments(DataSource):
    """``df.write.format("recording_documents").option("job", ...).save(root)`` for rows of ``fragments`` in order."""

    @classmethod
    def name(cls) -> str:
        return "recording_documents"

    def schema(self) -> str:
        return FRAGMENT

    def writer(self, schema: T.StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"].rstrip("/"), self.options["job"])


def join_pieces(pieces: pa.Table, writer: DocumentWriter) -> None:
    """The pieces of one recording, in order, become its document."""
    rows = pieces.sort_by([("section", "ascending"), ("pos", "ascending")]).to_pylist()
    out = NewFile(writer.document(rows[0]["rec"]))
    last = None
    for r in rows:
        out.write(opening(r["section"]) if last is None else joint(last, r["section"]))
        system, path = resolve(r["path"])
        with system.open_input_stream(path) as f:
            while block := f.read(BLOCK):
                out.write(block)
        last = r["last"]
    out.write(joint(last, None))
    out.publish()


def write_documents(events: DataFrame, envelopes: DataFrame, root: str, key: str = "rec_id", overwrite: bool = False) -> None:
    """Write every recording with an envelope; ``root`` must be new or empty, or is cleared first (``overwrite``).

    All fields of the recording model are kept, so loading gives the same events, envelopes and notes.  Names of
    recordings are percent-encoded as folder names.  Recordings without events have an empty list."""
    spark = events.sparkSession
    spark.dataSource.register(RecordingDocuments)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path) and len(fs.listStatus(path)):
        if not overwrite:
            raise FileExistsError(f"{root} isn't empty")
        fs.delete(path, True)
    fs.mkdirs(path)
    job = uuid.uuid4().hex[:12]
    order = ["rec", "section", "pos"]
    (fragments(events, envelopes, key).repartitionByRange(*order).sortWithinPartitions(*order)
     .write.format("recording_documents").option("job", job).mode("append").save(root))
    writer = DocumentWriter(root.rstrip("/"), job)

    def run(t: pa.Table) -> pa.Table:
        join_pieces(t, writer)
        return pa.table({"rec": [t.column("rec")[0].as_py()]})

    pieces = spark.read.schema("rec string, section int, pos long, last int, path string").json(f"{root}/_parts/{job}.json")
    pieces.groupBy("rec").applyInArrow(run, "rec string").write.format("noop").mode("overwrite").save()
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_parts"), True)
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{MARKER}")).close()


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """The documents of a finished ``write_documents``, as ``load_documents`` gives them, under their own names."""
    from clickloom.sources.recordings import load_documents
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{MARKER}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"{root} holds no finished set of recordings")
    docs = load_documents(spark, f"{root}/*/recording.json")
    # the folder's name, which the file's address encodes once more
    return docs.withColumn("rec_id", F.url_decode(F.url_decode("rec_id")))
