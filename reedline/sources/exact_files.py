"""A sink of exact files: each file is written whole by one task and appears under its name only when all are there.

    register(spark)
    lines.write.format("exact_files").mode("append").save(folder)        # columns: path, line

Rows must come sorted by path within a task, all rows of a path in one task, lines in order (see write). A line is written as it is, with its own ending. Tasks write hidden
part files; the commit moves them to their names, and refuses to touch a file that exists. A job that fails, or a task that is killed, leaves no file of its own behind.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "path string, line string"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExactFiles)


def write(lines: DataFrame, folder: str, order: list[str], progress: str | None = None) -> None:
    """Write the files that lines make: path (under folder), line and the columns of order, by which a file's lines are sorted. progress: a file that gets a JSON line for each file as it is finished.

    A file is one task's work, and streams through it. Null lines are left out.
    """
    register(lines.sparkSession)
    ordered = lines.where("line is not null").repartition("path").sortWithinPartitions("path", *order).select("path", "line")
    ordered.write.format("exact_files").mode("append").options(**({"progress": progress} if progress else {})).save(folder)


class ExactFiles(DataSource):
    """Options: path (the folder), progress."""

    @classmethod
    def name(cls) -> str:
        return "exact_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ExactFilesWriter(self.options["path"], self.options.get("progress"), overwrite)


@dataclass
class Parts(WriterCommitMessage):
    """Files that a task has written: (part file, name, bytes)."""

    files: list[tuple[str, str, int]]


def _store(address: str) -> tuple[fs.FileSystem, str]:
    if "://" in address and not address.startswith("file:"):
        return fs.FileSystem.from_uri(address)
    return fs.LocalFileSystem(), os.path.abspath(address.removeprefix("file://").removeprefix("file:"))


class ExactFilesWriter(DataSourceWriter):
    def __init__(self, folder: str, progress: str | None, overwrite: bool) -> None:
        self.folder, self.progress, self.overwrite, self.job = folder, progress, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Parts:
        store, root = _store(self.folder)
        task = TaskContext.get().taskAttemptId()
        done: list[tuple[str, str, int]] = []
        now, out, part = None, None, ""
        try:
            for path, line in iterator:
                if path != now:
                    if out:
                        done.append((part, now, self._closed(out)))
                    part, out = self._opened(store, root, path, f"{self.job}-{task}-{len(done)}")
                    now = path
                out.write(line.encode())
            if out:
                done.append((part, now, self._closed(out)))
        except BaseException:
            if out and not out.closed:
                out.close()
            for p in [*(d[0] for d in done), part]:
                if p and store.get_file_info(p).type == fs.FileType.File:
                    store.delete_file(p)
            raise
        return Parts(done)

    def _opened(self, store, root: str, path: str, name: str):
        clean = os.path.normpath(path)
        if os.path.isabs(clean) or clean.split(os.sep)[0] in ("..", ".", ""):
            raise ValueError(f"{path!r} is not a path under the folder")
        folder = os.path.dirname(os.path.join(root, clean))
        store.create_dir(folder, recursive=True)
        part = f"{folder}/.{name}.part"
        return part, store.open_output_stream(part)

    @staticmethod
    def _closed(out) -> int:
        size = out.tell()
        out.close()
        return size

    def commit(self, messages) -> None:
        store, root = _store(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        names = [os.path.join(root, os.path.normpath(name)) for _, name, _ in files]
        moved: list[str] = []
        try:
            if len(set(names)) < len(names):
                raise ValueError("a path came from two tasks")
            for (part, name, size), target in zip(files, names):
                self._moved(store, part, target)
                moved.append(target)
                if self.progress:
                    self._told(name, size)
        except BaseException:
            for target in moved if not self.overwrite else ():
                store.delete_file(target)
            self._swept(store, root)
            raise
        self._swept(store, root)

    def _moved(self, store, part: str, target: str) -> None:
        if self.overwrite:
            store.move(part, target)
        elif isinstance(store, fs.LocalFileSystem):
            os.link(part, target)  # fails where the name is taken, even just now
            os.unlink(part)
        elif store.get_file_info(target).type != fs.FileType.NotFound:
            raise FileExistsError(target)
        else:
            store.move(part, target)

    def _told(self, name: str, size: int) -> None:
        with open(self.progress, "a") as f:
            f.write(json.dumps({"file": name, "bytes": size}) + "\n")

    def abort(self, messages) -> None:
        self._swept(*_store(self.folder))

    def _swept(self, store, root: str) -> None:
        """No part file of this job stays, of killed tasks neither."""
        if store.get_file_info(root).type == fs.FileType.Directory:
            for one in store.get_file_info(fs.FileSelector(root, recursive=True)):
                if one.base_name.startswith(f".{self.job}-"):
                    store.delete_file(one.path)
