"""Working files of the multi-pass operators, kept in the folder that all executors share.

The folder is the one in ``spark.checkpoint.dir``; it is set here only where the session has none (tests). Files
written there survive the loss of an executor, and a task that runs again writes the same bytes under the same final
name, so attempts may overlap.
"""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc

from twinsieve.plans.workspace import Workspace, shared_root

__all__ = ["Workspace", "free_name", "open_fs", "read_part", "shared_root", "write_file", "write_part"]


def free_name(columns: list[str], name: str) -> str:
    """The name, with underscores behind it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow filesystem and path of a URI or a plain path."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[len("file:") :]
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), os.path.abspath(uri)


def _finish(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Give a finished file its name. An earlier attempt's file has the same bytes, so it may be replaced."""
    try:
        fs.move(temporary, final)
    except OSError:
        if fs.get_file_info(final).type != pafs.FileType.File:
            raise
        fs.delete_file(temporary)


def write_file(uri: str, chunks) -> int:
    """Write bytes objects to one file, under a temporary name until it is whole; returns its size."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    temporary, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with fs.open_output_stream(temporary, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    _finish(fs, temporary, path)
    return size


def write_part(uri: str, batches, schema: pa.Schema) -> None:
    """Write record batches as one compressed Arrow file."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary, compression=None) as out:
        with ipc.new_stream(out, schema, options=ipc.IpcWriteOptions(compression="zstd")) as writer:
            for batch in batches:
                writer.write_batch(batch)
    _finish(fs, temporary, path)


def read_part(uri: str):
    """The record batches of one file, one at a time."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as source:
        with ipc.open_stream(source) as reader:
            yield from reader
