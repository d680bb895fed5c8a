"""Files that tasks write to and read from the shared folder.

A task gives each file a name of its own attempt and reports it in its result; the result is
written as a table, and only files named there are ever read. A repeated or lost attempt
therefore leaves at most a file that nobody reads.
"""

from __future__ import annotations

import re
import uuid

from pyarrow import fs as pafs


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if m := re.match(r"file:/*(/.*)", path):
        path = m[1]
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def new_file(folder: str, part: int, ending: str) -> str:
    return f"{folder}/part-{part:05d}-{uuid.uuid4().hex}{ending}"


def create(path: str):
    """An output stream for a new file; makes its folder where that is needed."""
    store, inner = filesystem(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner, compression=None)


def open_ranges(path: str):
    """A file for ``read_at(length, offset)``."""
    store, inner = filesystem(path)
    return store.open_input_file(inner)
