"""Opening files of the shared folder inside tasks."""

from __future__ import annotations

import pyarrow.fs


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a uri (file://, hdfs://, s3:// ...) or local path."""
    if "://" in uri or uri.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
    return pyarrow.fs.LocalFileSystem(), uri


def write_bytes(uri: str, parts: list[bytes]) -> None:
    fs, path = opened(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as f:
        for part in parts:
            f.write(part)


def read_range(uri: str, start: int = 0, length: int | None = None) -> bytes:
    fs, path = opened(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(f.size() - start if length is None else length, start)


def read_tail(uri: str, length: int) -> bytes:
    """The last ``length`` bytes."""
    fs, path = opened(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(length, f.size() - length)
