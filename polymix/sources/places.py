"""Binary files that tasks write side by side: each part goes to the place that was computed for it, so no bytes pass through the driver
and a task that runs again writes the same bytes once more. This takes a file system that is mounted on every machine (``file://``); stores
without positional writes are refused."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse


def local_path(uri: str) -> str:
    if "://" not in uri and not uri.startswith("file:"):
        return uri
    parts = urlparse(uri)
    if parts.scheme != "file":
        raise ValueError(f"parts of {uri} can't be written at their places: a mounted path is needed")
    return unquote(parts.path)


def extend(uri: str, size: int) -> None:
    """The file, at least this long; places that nobody writes hold zeros."""
    path = local_path(uri)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "ab") as f:
        if f.tell() < size:
            f.truncate(size)


def begin(uri: str, size: int) -> None:
    """A draft beside the file; ``end`` puts it in the file's place once it is whole."""
    path = local_path(uri) + ".draft"
    if os.path.exists(path):
        os.remove(path)
    extend(path, size)


def end(uri: str, size: int) -> None:
    path = local_path(uri)
    if (found := os.path.getsize(path + ".draft")) != size:
        raise ValueError(f"{path} has {found} bytes instead of {size}")
    os.replace(path + ".draft", path)


class Writer:
    """An open file of a task."""

    def __init__(self, uri: str, draft: bool = True):
        self.handle = os.open(local_path(uri) + (".draft" if draft else ""), os.O_WRONLY)

    def put(self, at: int, data: bytes) -> None:
        view = memoryview(data)
        while view:
            done = os.pwrite(self.handle, view, at)
            view, at = view[done:], at + done

    def close(self) -> None:
        os.fsync(self.handle)
        os.close(self.handle)
