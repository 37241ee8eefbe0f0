"""Files that tasks write and read themselves, in the folder that the cluster shares."""

from __future__ import annotations

from uuid import uuid4

import pyarrow.fs as pafs


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path with or without a scheme, and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def new_file(folder: str, task: int, suffix: str) -> str:
    """A name no other attempt of this or another task has; only those that a finished task names count."""
    return f"{folder}/part-{task:06d}-{uuid4().hex}{suffix}"
