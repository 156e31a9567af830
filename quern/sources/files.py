"""Byte streams in the file systems that executors share, opened by URI."""

from __future__ import annotations

from pyarrow import fs


def _resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def open_output(uri: str):
    """A writable stream; folders above it are made."""
    system, path = _resolve(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)  # else pyarrow compresses by the name's ending


def open_input(uri: str):
    """A stream read from front to back."""
    system, path = _resolve(uri)
    return system.open_input_stream(path, compression=None)


def open_random(uri: str):
    """A file with seek and size."""
    system, path = _resolve(uri)
    return system.open_input_file(path)
