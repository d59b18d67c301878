"""Opening files of the shared folder from within tasks."""

from __future__ import annotations

import uuid


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def create(folder: str, name: str):
    """(path, output stream) of a new file; every attempt of a task takes its own name."""
    system, base = _at(folder)
    system.create_dir(base, recursive=True)
    leaf = f"{uuid.uuid4().hex}-{name}"
    return f"{folder}/{leaf}", system.open_output_stream(f"{base}/{leaf}", compression=None)


def open_file(path: str):
    """A seekable input file."""
    system, base = _at(path)
    return system.open_input_file(base)
