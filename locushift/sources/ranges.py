"""Byte ranges of files, read and written by tasks: any path that pyarrow's file systems open."""

from __future__ import annotations

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def opened(path: str):
    """A file to seek and read in."""
    system, own = place(path)
    return system.open_input_file(own)


def put(path: str, data: bytes) -> None:
    """A whole small file."""
    system, own = place(path)
    system.create_dir(own.rpartition("/")[0], recursive=True)
    with system.open_output_stream(own, compression=None) as f:
        f.write(data)
