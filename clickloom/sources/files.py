"""Files that tasks write to a folder all of them share, through Arrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that Spark knows (``file:``, ``hdfs:``, ``s3a:`` or plain), and the path there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class NewFile:
    """A file that appears under its name only when it is whole: written beside it first, then moved there.
    An attempt that runs again, or twice at once, replaces it by the same."""

    def __init__(self, path: str):
        self.system, self.path = resolve(path)
        self.folder, _, name = self.path.rpartition("/")
        self.system.create_dir(self.folder, recursive=True)
        self.held = f"{self.folder}/_{name}-{uuid.uuid4().hex[:12]}"
        self.stream = self.system.open_output_stream(self.held)

    def write(self, text: str | bytes) -> None:
        self.stream.write(text.encode() if isinstance(text, str) else text)

    def publish(self) -> None:
        self.stream.close()
        self.system.move(self.held, self.path)
