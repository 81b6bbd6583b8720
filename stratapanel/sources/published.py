"""What data sources written in Python share: finding files, and folders of parts that are published once all of them are written.

Tasks write whole files beside the table.  The commit drops what a lost task or a second attempt left and renames the folder, or moves
its files into a table that is appended to; an abort drops the folder.  The functions here reach tasks by value.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a path or an address such as ``file:/...`` or ``hdfs://...``."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def files_of(files: fs.FileSystem, path: str, suffix: str) -> list[str]:
    """The file itself, or the files of a folder that have the suffix and are not hidden."""
    found = files.get_file_info(path)
    if found.type == fs.FileType.File:
        return [path]
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    inside = files.get_file_info(fs.FileSelector(path))
    names = [f.path for f in inside if f.type == fs.FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "._"]
    if not names:
        raise FileNotFoundError(f"no {suffix} file in {path}")
    return sorted(names)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class PartWriter(DataSourceArrowWriter):
    """Writes each task's rows as files of a bounded size. ``file_of`` makes a whole file of some rows."""

    suffix = ""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool, part_bytes: int, part_rows: int = 2**62):
        self.path, self.schema, self.overwrite = path.rstrip("/"), schema, overwrite
        self.part_bytes, self.part_rows = part_bytes, part_rows
        self.beside = f"{self.path}._{uuid.uuid4().hex}"

    def file_of(self, table: pa.Table) -> bytes:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, beside = located(self.beside)
        files.create_dir(beside, recursive=True)
        context = TaskContext.get()
        names: list[str] = []
        held: list[pa.RecordBatch] = []

        def publish() -> None:
            name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(names):04d}{self.suffix}"
            body = self.file_of(pa.Table.from_batches(held))
            with files.open_output_stream(f"{beside}/{name}") as out:
                out.write(body)
            names.append(name)
            held.clear()

        for batch in iterator:
            each = max(1, batch.nbytes // max(1, batch.num_rows))
            at = 0
            while at < batch.num_rows:
                rows = min(self.part_rows - sum(b.num_rows for b in held), max(1, self.part_bytes // each - sum(b.num_rows for b in held)))
                held.append(batch.slice(at, rows))
                at += rows
                if sum(b.num_rows for b in held) >= min(self.part_rows, self.part_bytes // each):
                    publish()
        if held or not names and not context.partitionId():
            held = held or [pa.RecordBatch.from_pylist([], schema=to_arrow_schema(self.schema))]
            publish()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, path = located(self.path)
        _, beside = located(self.beside)
        wanted = {name for m in messages if m is not None for name in m.names}
        for f in files.get_file_info(fs.FileSelector(beside, allow_not_found=True)):
            if f.base_name not in wanted:
                files.delete_file(f.path)
        there = files.get_file_info(path).type
        if there != fs.FileType.NotFound and not self.overwrite:
            for name in sorted(wanted):
                files.move(f"{beside}/{name}", f"{path}/{name}")
            files.delete_dir(beside)
            return
        with files.open_output_stream(f"{beside}/_SUCCESS"):
            pass
        old = f"{beside}-old"
        if there != fs.FileType.NotFound:
            files.move(path, old)
        files.move(beside, path)
        if there == fs.FileType.Directory:
            files.delete_dir(old)
        elif there == fs.FileType.File:
            files.delete_file(old)

    def abort(self, messages: list[Written | None]) -> None:
        files, beside = located(self.beside)
        if files.get_file_info(beside).type != fs.FileType.NotFound:
            files.delete_dir(beside)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
