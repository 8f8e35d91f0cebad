"""Files of our own formats in the shared folder, opened from tasks through Arrow's file systems.

A task attempt writes under a name of its own and hands the name on in its rows; the table of those rows
is what readers go by, so files of failed or repeated attempts are never seen.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def new_name(folder: str, suffix: str) -> str:
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    system, path = resolve(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_random(uri: str):
    system, path = resolve(uri)
    return system.open_input_file(path)
