"""Files on any file system that Arrow knows, by URI or plain path."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow filesystem and path of a URI or a plain path."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[len("file:") :]
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), os.path.abspath(uri)


def open_seekable(uri: str) -> pa.NativeFile:
    """A file for reading at any place; only what is asked for is fetched."""
    fs, path = open_fs(uri)
    return fs.open_input_file(path)
