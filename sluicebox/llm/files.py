"""Binary files in the shared folder, read and written from tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        return fs.LocalFileSystem(), uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = place(uri)
    system.create_dir(path, recursive=True)


def open_for_writing(uri: str):
    system, path = place(uri)
    return system.open_output_stream(path, compression=None)


def open_for_reading(uri: str):
    system, path = place(uri)
    return system.open_input_file(path)


def remove(uri: str) -> None:
    system, path = place(uri)
    system.delete_file(path)


def attempt_name(folder: str, partition: int, suffix: str) -> str:
    """A name no other attempt uses: a task that runs again leaves the first file out of the manifest."""
    return f"{folder}/part-{partition:06d}-{uuid.uuid4().hex[:12]}{suffix}"
