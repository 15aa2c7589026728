"""Files in the shared folder, reached from Python workers by pyarrow's file systems."""

from __future__ import annotations

import atexit
import contextlib
import re

import pyarrow.fs as pafs


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a local path or URI (file, hdfs, s3, gs, abfs as pyarrow supports them)."""
    if m := re.match(r"file:/*(/.*)", uri):
        return pafs.LocalFileSystem(), m[1]
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def discard_at_exit(uri: str) -> None:
    """Delete a folder when the driver ends: what is read from it is read lazily, so not before."""

    def delete() -> None:
        with contextlib.suppress(OSError):
            fs, path = resolve(uri)
            fs.delete_dir(path)

    atexit.register(delete)
