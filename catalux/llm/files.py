"""Opening files of the shared folder inside tasks."""

from __future__ import annotations

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a URI (or of a plain local path, in local runs)."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def make_folder(path: str) -> None:
    where, inner = place(path)
    where.create_dir(inner, recursive=True)
