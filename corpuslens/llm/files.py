"""Binary files in a shared folder, read and written inside tasks."""

from __future__ import annotations

import re

from pyarrow import fs


def _resolve(path: str):
    """File system and inner path; ``file:/x`` and plain paths are local or mounted ones."""
    plain = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(path)


def write_file(path: str, data: bytes, attempt: str) -> None:
    """Write under a name of this attempt, then rename: readers never see half a file."""
    system, inner = _resolve(path)
    folder, _, name = inner.rpartition("/")
    system.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}.{attempt}"
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, inner)


def open_input(path: str):
    system, inner = _resolve(path)
    return system.open_input_file(inner)
