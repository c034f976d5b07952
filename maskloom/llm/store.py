"""Opening files of the shared store from executors, by URI."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def locate(uri: str):
    """(file system, path) of a URI; a plain path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def replacing(uri: str):
    """An output stream whose file appears under its name only when complete, so a task may run twice."""
    system, path = locate(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part) as out:
        yield out
    system.move(part, path)


def open_input(uri: str):
    system, path = locate(uri)
    return system.open_input_file(path)
