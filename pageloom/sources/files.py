"""Files written by tasks, on any file system that Arrow knows (local and mounted folders, HDFS, object stores)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


@contextmanager
def written_file(folder: str, name: str) -> Iterator:
    """A binary file to write, which stands under its name only once it is whole.

    Object stores show a file when it is closed; elsewhere it is renamed then.
    A task that is run again replaces what it wrote.
    """
    system, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    renames = system.type_name in ("local", "hdfs")
    if renames:
        system.create_dir(path, recursive=True)
    target = f"{path}/{name}"
    stream = system.open_output_stream(f"{target}.part" if renames else target)
    try:
        yield stream
    except BaseException:
        stream.close()
        system.delete_file(f"{target}.part" if renames else target)
        raise
    stream.close()
    if renames:
        system.move(f"{target}.part", target)
