"""Files that tasks write to, and read from, the shared folder.

A task gives each file a name of its own attempt and returns it as a row; only rows of attempts
that Spark accepted reach the manifest, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else "file://" + path)


def write_file(path: str, parts: list[bytes]) -> None:
    store, name = _at(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    with store.open_output_stream(name) as out:
        for part in parts:
            out.write(part)


def read_file(path: str) -> bytes:
    store, name = _at(path)
    with store.open_input_stream(name) as f:
        return f.read()
