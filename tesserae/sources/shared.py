"""Files of the shared folder, opened from Python on the driver and on executors."""

from __future__ import annotations

import pyarrow.fs as pafs

#: What Spark's file systems are called here; a dbfs path is a mounted folder.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "wasbs": "abfss"}


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path as Spark writes it, and the path in it."""
    scheme, colon, rest = uri.partition(":")
    if not colon:
        return pafs.LocalFileSystem(), uri
    if scheme == "dbfs":
        return pafs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")
