"""Zip and tar archives as a data source: partitions are byte ranges, members are read by offset.

The driver lists archives and their sizes. A task opens an archive, takes the
members whose header lies in its range from the archive's own index (the
directory of a zip, the headers of an uncompressed tar, passed over by seeking)
and reads those alone; a compressed tar has one range, as it can't be entered in
the middle. A task takes several ranges where archives are small, so that the
number of tasks grows with the bytes, not with the archives. No archive is ever a value in memory. An archive without a readable
index has no members; a member that doesn't unpack has a null content and its
``error``. Paths are those that Arrow's file systems open.
"""

from __future__ import annotations

import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

RANGE_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
MEMBERS = "path string, member string, ref string, offset long, size long, content binary, error string"
ZIPS, TARS, PACKED_TARS = (".zip",), (".tar",), (".tar.gz", ".tgz", ".tar.xz", ".tar.bz2")
FIELDS = pa.schema([("path", pa.string()), ("member", pa.string()), ("ref", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
#: What a damaged archive or member raises.
DAMAGED = (zipfile.BadZipFile, tarfile.TarError, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError, ValueError)


@dataclass
class Range:
    """Members of ``archive`` whose headers start in [start, end)."""

    archive: str
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """What one task reads, one after the other."""

    ranges: list[Range]


def plan(sizes: list[tuple[str, int]], range_bytes: int, tasks: int = 1 << 62) -> list[Ranges]:
    """Ranges of archives (path, bytes), dealt to about ``tasks`` tasks.

    A task gets 64 MB at most unless one range has more; ranges of one archive
    that follow each other become one.
    """
    found: list[Ranges] = []
    share = min(RANGE_BYTES, sum(size for _, size in sizes) // tasks)
    room = 0
    for path, size in sorted(sizes):
        whole = path.lower().endswith(PACKED_TARS)  # its offsets are those of the unpacked stream
        step = max(1, size) if whole else range_bytes
        for s in range(0, max(1, size), step):
            here = min(step, size - s)
            if not found or here > room:
                found.append(Ranges([]))
                room = share
            room -= here
            last = found[-1].ranges[-1] if found[-1].ranges else None
            if last and last.archive == path:
                last.end = s + step
            else:
                found[-1].ranges.append(Range(path, s, 1 << 62 if whole else s + step))
    return found


def zip_members(file: pa.NativeFile, start: int, end: int, content: bool) -> Iterator[tuple[str, int, int, bytes | None, str | None]]:
    """(name, offset, size, content, error) of a zip's members in a range."""
    with zipfile.ZipFile(file) as z:
        for info in z.infolist():
            if start <= info.header_offset < end and not info.is_dir():
                data = error = None
                if content:
                    try:
                        data = z.read(info)
                    except DAMAGED as e:
                        error = str(e)
                yield info.filename, info.header_offset, info.file_size, data, error


def tar_members(file: pa.NativeFile, start: int, end: int, content: bool, mode: str) -> Iterator[tuple[str, int, int, bytes | None, str | None]]:
    """The same of a tar; headers before the range are passed over."""
    with tarfile.open(fileobj=file, mode=mode) as t:
        while (info := t.next()) is not None and info.offset < end:
            t.members = []  # else they are all kept
            if info.isfile() and info.offset >= start:
                data = error = None
                if content:
                    try:
                        data = t.extractfile(info).read()
                        error = None if len(data) == info.size else "member ends early"
                        data = None if error else data
                    except DAMAGED as e:
                        error = str(e)
                yield info.name, info.offset, info.size, data, error


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, content: bool, range_bytes: int, tasks: int):
        self.path, self.content, self.range_bytes, self.tasks = path, content, range_bytes, tasks

    def partitions(self) -> list[Ranges]:
        system, root = pafs.FileSystem.from_uri(self.path)
        at = system.get_file_info(root)
        infos = [at] if at.is_file else system.get_file_info(pafs.FileSelector(root, recursive=True))
        return plan([(i.path, i.size) for i in infos if i.is_file and i.path.lower().endswith((*ZIPS, *TARS, *PACKED_TARS))], self.range_bytes, self.tasks) or [Ranges([])]

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for at in part.ranges:
            name = at.archive.lower()
            try:
                with system.open_input_file(at.archive) as file:
                    found = zip_members(file, at.start, at.end, self.content) if name.endswith(ZIPS) else tar_members(file, at.start, at.end, self.content, "r:" if name.endswith(TARS) else "r:*")
                    for member, offset, n, data, error in found:
                        rows.append((at.archive, member, f"{at.archive}!{member}", offset, n, data, error))
                        size += len(data or b"")
                        if size >= BATCH_BYTES:
                            yield self._batch(rows)
                            rows, size = [], 0
            except (zipfile.BadZipFile, tarfile.TarError, zlib.error, EOFError, pa.ArrowInvalid):
                pass  # what was read before stays
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(FIELDS)], schema=FIELDS)


class Archives(DataSource):
    """``spark.read.format("folio_archives").load(folder)``; options ``content``, ``range_bytes`` and ``tasks``."""

    @classmethod
    def name(cls) -> str:
        return "folio_archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> ArchiveReader:
        path = self.options["path"]
        return ArchiveReader(path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:"), self.options.get("content", "false") == "true", int(self.options.get("range_bytes", RANGE_BYTES)), int(self.options.get("tasks", 1 << 62)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Archives)
