"""Folders of any file system that pyarrow opens, for the data sources of this package."""

from __future__ import annotations

import os

from pyarrow import fs


def opened(folder: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path or URI, the path within it, and what stands before paths in URIs."""
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = folder.removeprefix("file:")
    if "://" not in folder:
        return fs.LocalFileSystem(), os.path.abspath(folder), "file:"
    system, path = fs.FileSystem.from_uri(folder)
    path = path.rstrip("/") or "/"
    bare = folder.rstrip("/")
    prefix = "file:" if folder.startswith("file:") else bare[: len(bare) - len(path)] if bare.endswith(path) else folder.split("://")[0] + "://"
    return system, path, prefix


def files_of(system: fs.FileSystem, path: str, recurse: bool) -> list[fs.FileInfo]:
    """Files under a folder, by path; a folder that is missing has none."""
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=recurse))
    return sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path)
