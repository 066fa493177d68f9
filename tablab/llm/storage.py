"""Plain binary files in the shared folder, for formats Spark has no writer for.

Every path is a URI that ``pyarrow.fs`` can open (a bare path counts as local).  A task writes under a name of its own
and reports it in a row; rows of the attempt that Spark commits name the files that count, so a lost or repeated task
leaves at worst a file that nothing refers to.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


#: Bytes a task reads by default, and tasks of one read at most (beyond that, tasks read more each: they hold a block at a
#: time, whatever they read in all).
TASK_BYTES, MOST_TASKS = 16 << 20, 50_000


def tasks_for(n_bytes: int | None, task_bytes: int = TASK_BYTES) -> int:
    """Number of tasks for reading ``n_bytes``.  An index is far smaller than what it stands for, so the tasks that read by
    it are counted from the bytes it names, not from its own size."""
    return max(1, min(MOST_TASKS, -(-(n_bytes or 0) // task_bytes)))


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class PartFile:
    """A new file under ``folder``, open for writing; ``uri`` and ``size`` tell where and how much."""

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"
        system, path = filesystem(self.uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.size = system.open_output_stream(path, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()


class RangeReader:
    """Byte ranges of files, one open file at a time."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            system, path = filesystem(uri)
            self.uri, self.file = uri, system.open_input_file(path)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.uri, self.file = None, None
