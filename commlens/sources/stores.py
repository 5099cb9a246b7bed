"""Files by path in whatever store a path names, for data sources that read or write them in tasks."""

from __future__ import annotations

from pathlib import Path

from pyarrow import fs


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it; any characters may stand in local paths."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        store, base = fs.FileSystem.from_uri(path)
        return store, base.rstrip("/")
    return fs.LocalFileSystem(), str(Path(path).absolute())
