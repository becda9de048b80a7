"""Files in the shared folder, from Python on any machine, through pyarrow's file systems."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyarrow import fs


def at(uri: str) -> tuple[Any, str]:
    """The file system and the path within it."""
    if re.match("file:/(?!/)", uri):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write(uri: str, data: bytes) -> None:
    system, path = at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as f:
        f.write(data)


def read(uri: str) -> bytes:
    system, path = at(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def blocks(uri: str, size: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes, some at a time."""
    system, path = at(uri)
    with system.open_input_stream(path, compression=None) as f:
        while data := f.read(size):
            yield data


def remove(uri: str) -> None:
    """Remove a folder and what is in it, if it is there."""
    system, path = at(uri)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def move(old: str, new: str) -> None:
    """Rename, once: if it was done by an attempt that got lost, nothing is left to do."""
    system, a = at(old)
    _, b = at(new)
    if system.get_file_info(a).type == fs.FileType.NotFound and system.get_file_info(b).type == fs.FileType.File:
        return
    system.create_dir(b.rpartition("/")[0], recursive=True)
    system.move(a, b)
