"""Media columns: archives of media members in the shared folder, read by a data source of byte ranges.

Writing: each task puts its rows into ZIP archives as 8-bit mono WAV members, one sample for each byte, and
starts a new archive at `archive_bytes`. The files get their final names in the driver's commit, so attempts that
failed leave nothing that is read; what they wrote is deleted with the commit, or when the job is given up. The archives of the query lie in the
application's folder below the shared one, which `session.clear_scratch` removes.

Reading: `media_archive` lists the archives and plans byte ranges of them. A task opens its archive, takes the members
whose header starts in its range from the archive's directory, and streams them as Arrow batches of bounded
size. Each member is read by its offset and checked against its CRC; a failed one is retried alone with the file opened
anew, and if it keeps failing it becomes a row with `error` and null `media`, not a failed task.

Null texts are empty; a payload has one block of 64 zero bytes at least; null keys, repeated rows and empty tables are kept
as they are (one member a row; no archive for an empty table, which reads as no rows). A text of any length is one member. Other columns of the table are
not looked at, so their names may clash.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from packetloom.llm.common import documents, scratch, whole_text

BLOCK = 64
RATE = 8000
SCHEMA = "member string, offset long, media binary, attempts int, error string"
BATCH_BYTES = 4 << 20


def wav(payload: bytes) -> bytes:
    """An 8-bit mono WAV file whose samples are the payload, which has an even length."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def samples(media: bytes) -> bytes:
    """The payload of a file that `wav` made."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or media[36:40] != b"data":
        raise ValueError("no 8-bit WAV file")
    return media[44 : 44 + struct.unpack_from("<I", media, 40)[0]]


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Archives(WriterCommitMessage):
    names: list[str]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", 16 << 20))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[ByteRange]:
        store, root = open_store(self.path)
        found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        files = sorted((i.path, i.size) for i in found if i.is_file and i.path.endswith(".zip"))
        return [ByteRange(p, k, k + self.range_bytes) for p, size in files for k in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = open_store(self.path)
        rows, size = [], 0
        for row in read_range(lambda: store.open_input_file(partition.path), partition.start, partition.end, self.attempts):
            rows.append(row)
            size += len(row[2] or b"")
            if size >= BATCH_BYTES:
                yield arrow(rows)
                rows, size = [], 0
        if rows:
            yield arrow(rows)


def arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["member", "offset", "media", "attempts", "error"])


#: What another attempt may cure.
FAULTS = (OSError, zipfile.BadZipFile, zlib.error, EOFError)


def read_range(opened: Callable[[], io.RawIOBase], start: int, end: int, attempts: int) -> Iterator[tuple]:
    """(name, offset, bytes or None, attempts made, error or None) of each member whose header starts in [start, end).

    Opening the archive anew is part of a member's next attempt. The first opening, without which no member is known, has as many attempts; then its error is raised.
    """
    archive = None

    def close() -> None:
        nonlocal archive
        if archive is not None:
            held, archive = (archive, archive.fp), None
            for f in held:
                f.close()

    def open_again() -> zipfile.ZipFile:
        f = opened()
        try:
            return zipfile.ZipFile(f)
        except BaseException:
            f.close()
            raise

    for k in range(1, attempts + 1):
        try:
            archive = open_again()
            break
        except FAULTS:
            if k == attempts:
                raise
    try:
        for info in archive.infolist():
            if not start <= info.header_offset < end:
                continue
            media = error = None
            for k in range(1, attempts + 1):
                try:
                    archive = archive or open_again()
                    media, error = archive.read(info), None
                    break
                except FAULTS as e:
                    error = f"{type(e).__name__}: {e}"
                    close()
            yield info.filename, info.header_offset, media, k, error
    finally:
        close()


class ArchiveWriter(DataSourceWriter):
    """Rows (member, media) to archives under `path`."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.archive_bytes = int(options.get("archiveBytes", 128 << 20))
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Archives:
        store, root = open_store(self.path)
        names: list[str] = []
        archive = out = None
        for member, media in iterator:
            if archive is None:
                store.create_dir(root)
                names.append(f"{self.job}-{uuid.uuid4().hex}.zip")
                out = store.open_output_stream(posixpath.join(root, "_" + names[-1]))
                archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
            archive.writestr(zipfile.ZipInfo(member), media, zipfile.ZIP_DEFLATED, 1)
            if out.tell() >= self.archive_bytes:
                archive.close()
                out.close()
                archive = None
        if archive is not None:
            archive.close()
            out.close()
        return Archives(names)

    def commit(self, messages: list) -> None:
        store, root = open_store(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            store.move(posixpath.join(root, "_" + name), posixpath.join(root, name))
        self.abort([])  # what attempts have left that were not counted

    def abort(self, messages: list) -> None:
        store, root = open_store(self.path)
        for i in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if posixpath.basename(i.path).startswith(f"_{self.job}-"):
                store.delete_file(i.path)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options)


def store_texts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Stores each row's text as a member `row_key.wav` below `path`; the unpadded size is kept in its name too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, media, size = [], [], 0
            for row, k, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                n, payload = padded(t)
                names.append(f"{row}_{n}_{'null' if k is None else k}.wav")
                media.append(wav(payload))
                size += len(payload)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary())], ["member", "media"])
                    names, media, size = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary())], ["member", "media"])

    rows = df.select(F.monotonically_increasing_id().alias("row"), df[key].cast("long").alias("key"), whole_text(df, text).alias("text"))
    df.sparkSession.dataSource.register(ArchiveSource)
    rows.mapInArrow(run, "member string, media binary").write.format("media_archive").mode("append").option("path", path).save()


def read_media(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """member, offset, media, attempts, error of each member of the archives below `path`."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("path", path).options(**options).load()


def feature(payload: bytes) -> str:
    """Mean, root mean square, crossings of the middle and entropy of the samples."""
    x = np.frombuffer(payload, "u1")
    counts = np.bincount(x, minlength=256)
    n = len(x)
    levels = np.arange(256)
    mean = int(counts @ levels) / n
    power = int(counts @ (levels - 128) ** 2) / n
    p = counts[counts > 0] / n
    above = x >= 128
    return f"n={n};mean={mean:.4f};rms={power**0.5:.4f};cross={int(np.count_nonzero(above[1:] != above[:-1]))};entropy={float(-(p * np.log2(p)).sum()):.4f}"


def features(media: DataFrame) -> DataFrame:
    """doc_id, sizes, digests and the feature of each member that `store_texts` stored. Members that could not be read fail the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, data, error in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("member", "media", "error"))):
                if error is not None:
                    raise OSError(f"{name}: {error}")
                _, n, k = name.removesuffix(".wav").split("_")
                payload = samples(data)
                rows.append((None if k == "null" else int(k), int(n), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("member", "media", "error").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "media")
    store_texts(documents(spark, sf_dir), path)
    return features(read_media(spark, path))
