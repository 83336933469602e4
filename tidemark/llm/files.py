"""Byte files in the shared folder, by any path that Arrow's file systems read (file, hdfs, s3, gs)."""

from __future__ import annotations

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def write(path: str, data: bytes) -> None:
    """The whole file or none of it under its final name: names are never used twice, so a task that
    is run again writes another file and the manifest names the one that counts."""
    where, name = at(path)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    with where.open_output_stream(name) as f:
        f.write(data)


class Ranges:
    """Reads byte ranges of one file."""

    def __init__(self, path: str):
        where, name = at(path)
        self.file = where.open_input_file(name)
        self.size = self.file.size()

    def __call__(self, start: int, length: int) -> bytes:
        start = max(0, start)
        return self.file.read_at(max(0, min(length, self.size - start)), start)

    def close(self) -> None:
        self.file.close()
