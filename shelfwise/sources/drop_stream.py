"""The files of a drop folder as a stream that holds young files back.

A Python data source, ``spark.readStream.format("drop_folder")``. A poll lists the folder and offers
every file of a drop-file name that has been quiet for ``quietSeconds``; a file that is still being written is
left for a later poll, so it is read once and whole. The offset of a poll holds its files (path, modification
time, size): a batch that is run again after a crash gets the same files, whatever the folder holds by then.

Rows are files, not lines: (path, name, mtime in ms, size, head), where head is the first lines as bytes (at least
``HEAD_LINES`` of them, up to the first that is not empty), null for a file that is gone. The consumer reads contents with Spark and
moves each file away; one that it leaves in the folder is offered again by the next poll.

``path`` is a local path or a URI that ``pyarrow.fs`` opens (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import json
import re
import sys
import time
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from shelfwise.sources.dropfile import FILE_NAME_RE, PLAIN_NAME_RE, QUIET_SECONDS

SCHEMA = "path string, name string, mtime long, size long, head binary"
#: Lines that a file's charset is judged by, and bytes read at a time.
HEAD_LINES, READ_BYTES = 3, 65_536

# Executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class DropFile(InputPartition):
    path: str
    name: str
    mtime: int
    size: int

    def __post_init__(self):
        super().__init__(self.path)


def _opened(path: str):
    """The file system of a path, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def ready_files(folder: str, quiet_seconds: float, now: float | None = None) -> list[tuple[str, str, int, int]]:
    """(path, name, mtime, size) of the drop files of a folder that have not changed for ``quiet_seconds``, by name."""
    from pyarrow import fs

    system, root = _opened(folder)
    youngest = (time.time() if now is None else now) - quiet_seconds
    found = []
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        named = re.match(FILE_NAME_RE, info.base_name) or re.match(PLAIN_NAME_RE, info.base_name)
        if info.type == fs.FileType.File and named and info.mtime_ns / 1e9 <= youngest:
            found.append((f"{folder.rstrip('/')}/{info.base_name}", info.base_name, info.mtime_ns // 1_000_000, info.size))
    return sorted(found, key=lambda f: _in_sequence(f[1]))


def _in_sequence(name: str):
    """Order of loading: the sequence number (10 after 2), files without one last, then the name."""
    number = re.match(r"(\d+)\.", name)
    return (0, int(number[1]), name) if number else (1, 0, name)


def head_of(path: str) -> bytes | None:
    """The first lines of a file: ``HEAD_LINES``, or more until one is not empty."""
    system, inner = _opened(path)
    try:
        with system.open_input_stream(inner) as source:
            held = b""
            while chunk := source.read(READ_BYTES):
                held += chunk
                lines = held.split(b"\n")[:-1]
                if len(lines) >= HEAD_LINES and any(line.strip() for line in lines):
                    first = next(k for k, line in enumerate(lines) if line.strip())
                    return b"\n".join(lines[:max(HEAD_LINES, first + 1)])
            return held
    except FileNotFoundError:
        return None


class DropFolderReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.quiet = float(options.get("quietSeconds", QUIET_SECONDS))
        self.most = int(options.get("maxFiles", 0))
        self.last = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"poll": "0", "files": "[]"}

    def latestOffset(self) -> dict:
        files = ready_files(self.folder, self.quiet)
        if files:
            # A poll is a point in time: later polls have higher numbers, also after a restart.
            self.last = {"poll": str(time.time_ns()), "files": json.dumps(files[:self.most] if self.most else files)}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[DropFile]:
        return [DropFile(*f) for f in json.loads(end["files"])] if start["poll"] != end["poll"] else []

    def read(self, partition: DropFile):
        yield partition.path, partition.name, partition.mtime, partition.size, head_of(partition.path)

    def commit(self, end: dict) -> None:
        """Files are moved by the consumer."""


class DropFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "drop_folder"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DropFolderReader:
        return DropFolderReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DropFolder)
