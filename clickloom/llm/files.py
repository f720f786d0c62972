"""Files that workers write to, and read from, the cluster's shared folder.

Paths are those Spark knows (``file:``, ``hdfs:``, ``s3a:`` or plain); Arrow's
file systems open them inside tasks, memory-mapped where the folder is mounted.
Each writing task gives its file a name of its own, and only names returned by
successful tasks are ever read, so retried and speculative tasks do no harm.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs as pafs


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def create(folder: str, name: str) -> tuple[str, pa.NativeFile]:
    """A new file in ``folder``: its path, and the stream to write it to."""
    path = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    system, local = resolve(path)
    system.create_dir(local.rpartition("/")[0], recursive=True)
    return path, system.open_output_stream(local)


def open_file(path: str) -> pa.NativeFile:
    """For random access: a memory map of a mounted file, else a seekable stream."""
    system, local = resolve(path)
    return pa.memory_map(local) if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(local)
