"""Media columns: a Spark data source over archives of lossless images.

A payload is stored as the samples of an 8-bit grey image, 192 samples a row,
in a PNG file, so the stored form is compressed but exact. Images are members
of zip archives, which a writer task streams to the shared folder; an archive
becomes part of the data set when the manifest, written once at commit, names
it, so lost or repeated task attempts leave nothing behind that is read.

The data source ``archive_members`` reads them back. The driver reads only the
manifest (one line per archive) and plans byte ranges over the archives. A
task opens its archive, reads the archive's own directory, takes the members
that begin inside its range, and streams them in Arrow batches. A member is
read by its offset and checked against the directory's checksum; a failed read
is repeated, with a newly opened file, for that member alone.

Defined cases: a null or empty text is one row of blanks; rows with equal ids
are separate members; an empty table gives no member; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from folioframe.session import shared_folder, table

WIDTH = 192
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 4
LEVEL = 3
MANIFEST = "_manifest.jsonl"
MEMBERS = "doc_id long, n_bytes long, archive string, offset long, media binary"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(unpadded bytes, payload): UTF-8, with blanks up to a positive multiple of 192."""
    data = (text or "").encode("utf-8")
    return len(data), data + b" " * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def encode_png(payload: bytes) -> bytes:
    """A grey 8-bit image whose samples are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of an image that ``encode_png`` made; damage raises ValueError."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not an image")
    at, data, height = 8, [], 0
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged image")
        if kind == b"IHDR":
            height = struct.unpack(">II", body[:8])[1]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    return lines[:, 1:].tobytes()


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]] = field(default_factory=list)


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri("file://" + path)


class _Sink:
    """What zipfile needs of a file that can't seek."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.size = stream, 0

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        pass


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, archive_bytes: int) -> None:
        self.path, self.archive_bytes = path, archive_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        done, sink, archive, n = Written(), None, None, 0
        name = ""

        def close() -> None:
            archive.close()
            sink.stream.close()
            done.archives.append((name, sink.size))

        for batch in iterator:
            ids, sizes, media = (batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", "n_bytes", "media"))
            for i in range(batch.num_rows):
                if sink is None:
                    name, n = f"part-{uuid.uuid4().hex}.zip", 0
                    sink = _Sink(system.open_output_stream(f"{root}/{name}"))
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
                archive.writestr(f"{n}/{ids[i].as_py()}/{sizes[i].as_py()}.png", media[i].as_py())
                n += 1
                if sink.size >= self.archive_bytes:
                    close()
                    sink = None
        if sink is not None:
            close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        lines = "".join(json.dumps({"archive": a, "size": s}) + "\n" for m in messages if m for a, s in m.archives)
        with system.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(lines.encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        for a, _ in (x for m in messages if m for x in m.archives):
            system.delete_file(f"{root}/{a}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int) -> None:
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[ByteRange]:
        system, root = _open(self.path)
        with system.open_input_stream(f"{root}/{MANIFEST}") as f:
            archives = [json.loads(x) for x in f.read().decode().splitlines()]
        found = [ByteRange(a["archive"], s, s + self.range_bytes) for a in archives for s in range(0, a["size"], self.range_bytes)]
        return found or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        system, root = _open(self.path)
        path = f"{root}/{partition.archive}"
        rows: list[tuple] = []
        size = 0
        members = retried(lambda: _directory(system, path, partition.start, partition.end))
        file = system.open_input_file(path)
        try:
            for info in members:
                try:
                    media = _member(file, info)
                except (OSError, ValueError):
                    file.close()
                    file = system.open_input_file(path)
                    media = retried(lambda info=info: _reread(system, path, info))
                _, doc_id, n = info.filename.removesuffix(".png").split("/")
                rows.append((None if doc_id == "None" else int(doc_id), int(n), partition.archive, info.header_offset, media))
                size += len(media)
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        finally:
            file.close()
        if rows:
            yield _batch(rows)


def retried(read, attempts: int = ATTEMPTS):
    """``read()``, repeated with growing pauses while it fails."""
    for k in range(attempts):
        try:
            return read()
        except (OSError, ValueError, zipfile.BadZipFile):
            if k == attempts - 1:
                raise
            time.sleep(0.1 * 2**k)


def _directory(system: pafs.FileSystem, path: str, start: int, end: int) -> list[zipfile.ZipInfo]:
    with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
        return [i for i in z.infolist() if start <= i.header_offset < end]


def _member(file: pa.NativeFile, info: zipfile.ZipInfo) -> bytes:
    """The bytes of the member at an offset, checked against the directory."""
    head = file.read_at(30, info.header_offset)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member at this offset")
    name, extra = struct.unpack("<HH", head[26:30])
    data = file.read_at(info.compress_size, info.header_offset + 30 + name + extra)
    if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
        raise ValueError("damaged member")
    return data


def _reread(system: pafs.FileSystem, path: str, info: zipfile.ZipInfo) -> bytes:
    with system.open_input_file(path) as f:
        return _member(f, info)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "archive", "offset", "media"])


class ArchiveMembers(DataSource):
    """``spark.read.format("archive_members").load(folder)``; options ``archive_bytes`` and ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE_BYTES)))


def media_rows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One stored image per document, in the schema of the members."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for value in batch.column(1):
                n, payload = payload_of(value.as_py())
                sizes.append(n)
                media.append(encode_png(payload))
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), none.cast(pa.string()), none.cast(pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "archive", "offset", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(store, MEMBERS)


def write_archives(rows: DataFrame, folder: str, **options: object) -> None:
    rows.sparkSession.dataSource.register(ArchiveMembers)
    rows.write.format("archive_members").mode("append").options(**options).save(folder)


def read_archives(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").options(**options).load(folder)


def feature_of(payload: bytes) -> str:
    """Size, mean, deviation, entropy and edge strength of the samples."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    edges = np.abs(np.diff(x.reshape(-1, WIDTH).astype(np.int16), axis=1)).mean()
    return f"rows={len(x) // WIDTH};mean={x.mean():.4f};std={x.std():.4f};entropy={max(0.0, float(-(p * np.log2(p)).sum())):.4f};edges={edges:.4f}"


def media_features(members: DataFrame) -> DataFrame:
    """Digests and features of the payloads decoded from ``members``."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for media in batch.column(2).to_pylist():
                payload = decode_png(media)
                values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload))
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], ["doc_id", "n_bytes", *out])

    return members.select("doc_id", "n_bytes", "media").mapInArrow(
        describe, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op9_media_columns(spark, sf_dir):
    """Every document stored as an image in an archive, read back and described."""
    folder = f"{shared_folder(spark)}/media-{uuid.uuid4().hex}"
    write_archives(media_rows(table(spark, sf_dir, "documents")), folder)
    return media_features(read_archives(spark, folder))
