"""Files that tasks read and write themselves, wherever the shared folder is."""

from __future__ import annotations

from pyarrow import fs


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """File system of a folder and the path in it: mounted paths, ``file:`` addresses, or what Arrow can open."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    if "://" in folder:
        return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), folder
