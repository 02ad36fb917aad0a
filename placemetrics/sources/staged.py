"""Writing files in parts: tasks stage them, the job's commit moves them in."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, InputPartition, WriterCommitMessage


def register_source(spark: SparkSession, source: type[DataSource]) -> None:
    """Make a source known; it is sent by value, so that executors need no installed package."""
    for module in (__name__, source.__module__):
        cloudpickle.register_pickle_by_value(sys.modules[module])
    spark.dataSource.register(source)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Part(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class StagedWriter(DataSourceWriter):
    """Parts of at most ``rows_per_part`` rows, each one file for every one of ``suffixes``.

    A task that is run again or a job that fails leaves nothing half written in the folder.
    """

    rows_per_part: int
    suffixes: Sequence[str]

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def contents(self, rows: Sequence[tuple]) -> Sequence[bytes]:
        """What a part's files hold, in the order of ``suffixes``."""
        raise NotImplementedError

    def _folders(self) -> tuple[fs.FileSystem, str, str]:
        files, folder = opened(self.path)
        return files, folder, f"{folder}/_staged-{self.job}"

    def write(self, iterator: Iterator[T.Row]) -> WriterCommitMessage:
        files, _, staged = self._folders()
        files.create_dir(staged, recursive=True)
        names, rows = [], []
        for row in iterator:
            rows.append(tuple(row))
            if len(rows) == self.rows_per_part:
                names.append(self._stage(files, staged, rows))
                rows = []
        if rows:
            names.append(self._stage(files, staged, rows))
        return Written(names)

    def _stage(self, files: fs.FileSystem, staged: str, rows: list[tuple]) -> str:
        name = f"part-{uuid.uuid4().hex}"
        for suffix, data in zip(self.suffixes, self.contents(rows)):
            with files.open_output_stream(f"{staged}/{name}.{suffix}") as out:
                out.write(data)
        return name

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Only the parts of tasks that Spark counts are moved in; old parts go after that."""
        files, folder, staged = self._folders()
        names = [name for message in messages if message for name in message.names]
        files.create_dir(staged, recursive=True)
        if not names:  # without rows there still are columns
            names = [self._stage(files, staged, [])]
        old = [i.path for i in files.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File]
        # the first suffix, by which readers find a part, comes last
        for suffix in reversed(self.suffixes):
            for name in names:
                files.move(f"{staged}/{name}.{suffix}", f"{folder}/{name}.{suffix}")
        if self.overwrite:
            for path in old:
                if path.rsplit(".", 1)[-1] in self.suffixes:
                    files.delete_file(path)
        files.delete_dir(staged)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _, staged = self._folders()
        if files.get_file_info(staged).type == fs.FileType.Directory:
            files.delete_dir(staged)


def parts_of(path: str, suffix: str) -> list[str]:
    """Paths of the files with a suffix in a folder, in order; a file is its own part."""
    files, folder = opened(path)
    if folder.endswith(f".{suffix}"):
        return [folder]
    found = sorted(i.path for i in files.get_file_info(fs.FileSelector(folder)) if i.path.endswith(f".{suffix}"))
    if not found:
        raise FileNotFoundError(f"no .{suffix} in {folder}")
    return found
