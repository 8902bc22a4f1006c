"""Files that tasks read and write beside Spark's own formats, in any store that pyarrow reaches."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from typing import BinaryIO

from pyarrow import fs


def _local(path: str) -> str | None:
    """The plain path, if it is in a mounted file system."""
    return re.sub(r"^file:/*", "/", path) if path.startswith(("file:", "/")) else None


def open_read(path: str) -> BinaryIO:
    local = _local(path)
    if local:
        return open(local, "rb")
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def write_whole(path: str, write: Callable[[BinaryIO], None]) -> None:
    """Write a file under another name and then move it, so that a task that is lost, repeated or run
    twice leaves the whole file or none."""
    local, part = _local(path), f"{path}.{uuid.uuid4().hex}.part"
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(_local(part), "wb") as f:
            write(f)
        os.replace(_local(part), local)
        return
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(name))
    temp = fs.FileSystem.from_uri(part)[1]
    with store.open_output_stream(temp) as f:
        write(f)
    store.move(temp, name)
