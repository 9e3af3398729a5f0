"""Media columns: a Spark data source of media members in archive files, read by byte ranges through Arrow."""

from __future__ import annotations

import hashlib
import json
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from folio.llm.common import scratch, table

BLOCK = 512  # of tar
WIDTH = 64
SCHEMA = "archive string, offset long, member string, media binary"
MANIFESTS, INDEX = "_manifests", ".idx"


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    archive: str
    size: int


@dataclass
class ByteRange(InputPartition):
    """Members of the archive that begin at the marks from the first at or after start to before the first at or after end."""

    archive: str
    start: int
    end: int
    size: int


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes one tar file of its own name and, beside it, an index: the offset of a
    member every `mark_bytes` or so. A commit adds one file to the folder of manifests, which
    names the archives of the tasks that succeeded and their sizes; it appears whole or not at all."""

    def __init__(self, path: str, mark_bytes: int):
        self.path, self.mark_bytes = path, mark_bytes

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _at(self.path)
        fs.create_dir(root, recursive=True)
        name, at, marks = f"part-{uuid.uuid4().hex}.tar", 0, []
        with fs.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                for member, media in zip(batch.column("member").to_pylist(), batch.column("media"), strict=True):
                    if not marks or at - marks[-1] >= self.mark_bytes:
                        marks.append(at)
                    raw = media.as_buffer()
                    info = tarfile.TarInfo(member)
                    info.size = len(raw)
                    head = info.tobuf(tarfile.GNU_FORMAT)
                    out.write(head)
                    out.write(raw)
                    out.write(b"\0" * (pad := -len(raw) % BLOCK))
                    at += len(head) + len(raw) + pad
            out.write(b"\0" * 2 * BLOCK)
        with fs.open_output_stream(f"{root}/{name}{INDEX}") as out:
            out.write(np.array(marks, np.int64).tobytes())
        return Written(name, at)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _at(self.path)
        fs.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        name = f"{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{root}/{name}.part") as f:
            f.write(json.dumps([[m.archive, m.size] for m in messages if m and m.size]).encode())
        fs.move(f"{root}/{name}.part", f"{root}/{MANIFESTS}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _at(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/{m.archive}")
                fs.delete_file(f"{root}/{m.archive}{INDEX}")


class _Window:
    """Bytes of a file at any offset, read ahead; a failed read reopens the file and tries again at the same offset."""

    def __init__(self, path: str, ahead: int, tries: int):
        self.path, self.ahead, self.tries, self.file = path, ahead, tries, None
        self.start, self.held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.start <= at <= at + n <= self.start + len(self.held):
            for left in range(self.tries - 1, -1, -1):
                try:
                    if self.file is None:
                        fs, p = _at(self.path)
                        self.file = fs.open_input_file(p)
                    self.start, self.held = at, self.file.read_at(max(n, self.ahead), at)
                    break
                except OSError:
                    self.file = None
                    if not left:
                        raise
                    time.sleep(0.1 * (self.tries - left))
        if at + n > self.start + len(self.held):
            raise EOFError(f"{self.path} ends before {at + n}")
        return self.held[at - self.start : at - self.start + n]

    def forget(self) -> None:
        self.held, self.file = b"", None


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, batch_bytes: int, tries: int):
        self.path, self.range_bytes, self.batch_bytes, self.tries = path, range_bytes, batch_bytes, tries

    def partitions(self) -> list[ByteRange]:
        """Ranges of about range_bytes; the driver knows names and sizes only, offsets are for the tasks to look up."""
        fs, root = _at(self.path)
        files = fs.get_file_info(pafs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
        out = []
        for file in sorted(files, key=lambda f: f.path):
            with fs.open_input_stream(file.path) as f:
                for archive, size in json.loads(f.read()):
                    out += [ByteRange(archive, at, min(at + self.range_bytes, size), size) for at in range(0, size, self.range_bytes)]
        return out or [ByteRange("", 0, 0, 0)]

    def bounds(self, part: ByteRange) -> tuple[int, int]:
        """Offsets of the first member of the range and of the first one behind it."""
        fs, root = _at(self.path)
        with fs.open_input_stream(f"{root}/{part.archive}{INDEX}") as f:
            marks = np.append(np.frombuffer(f.read(), np.int64), part.size)
        first, last = np.searchsorted(marks, [part.start, part.end])
        return int(marks[first]), int(marks[last])

    def member(self, window: _Window, at: int) -> tuple[str, bytes, int]:
        """Name, media and end of the member at an offset. A bad header or a short read is tried again from that offset."""
        for left in range(self.tries - 1, -1, -1):
            try:
                info = tarfile.TarInfo.frombuf(window.read(at, BLOCK), "utf-8", "surrogateescape")
                body = window.read(at + BLOCK, info.size)
                return info.name, body, at + BLOCK + info.size + -info.size % BLOCK
            except (tarfile.HeaderError, EOFError):
                window.forget()
                if not left:
                    raise

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.size:
            return
        window, (at, end) = _Window(f"{self.path}/{part.archive}", 1 << 20, self.tries), self.bounds(part)
        rows, size = [], 0
        while at < end:
            name, media, after = self.member(window, at)
            rows.append((part.archive, at, name, media))
            size, at = size + len(media), after
            if size >= self.batch_bytes or at >= end or len(rows) >= 1000:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(cols, names=["archive", "offset", "member", "media"])
                rows, size = [], 0


class MediaArchive(DataSource):
    """format("media_archive"): `path`, range_bytes (of a partition), batch_bytes, tries, mark_bytes.

    Columns: archive, offset (of the member in it), member (its name), media (its bytes).
    Paths go through pyarrow's file systems, so that shared and object stores work.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def _n(self, key: str, default: int) -> int:
        return int(self.options.get(key, default))

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self._n("range_bytes", 16 << 20), self._n("batch_bytes", 4 << 20), self._n("tries", 3))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], self._n("mark_bytes", 4 << 20))


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with bytes 0 up to a positive multiple of WIDTH, and the length before."""
    raw = (text or "").encode()
    return raw + b"\0" * (max(WIDTH, len(raw) + -len(raw) % WIDTH) - len(raw)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(samples: bytes, n_bytes: int) -> bytes:
    """A PNG file, 8-bit grey, WIDTH wide, whose samples are the payload; its text says the unpadded length."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def from_image(media: bytes) -> tuple[np.ndarray, int]:
    """Samples (rows x WIDTH) and unpadded length of what to_image made; its checksums are verified."""
    at, idat, n_bytes = 8, b"", 0
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError("damaged image")
        if kind == b"IDAT":
            idat += data
        elif kind == b"tEXt":
            n_bytes = int(data.partition(b"\0")[2])
        at += 12 + n
    return np.frombuffer(zlib.decompress(idat), np.uint8).reshape(-1, WIDTH + 1)[:, 1:], n_bytes


def feature(samples: np.ndarray) -> str:
    """Sum of the samples, and a bit for each column that is brighter than the mean column."""
    cols = samples.sum(0, dtype=np.int64)
    total = int(cols.sum())
    return f"{total}-{int(''.join('01'[int(x * WIDTH > total)] for x in cols), 2):016x}"


def write_media(docs: DataFrame, path: str) -> None:
    """Archives every whole text of docs(doc_id, text) under path; members are named after doc_id (`null.png` for null)."""
    docs.sparkSession.dataSource.register(MediaArchive)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for at in range(0, len(ids), 64):
                media = [to_image(*payload(t.as_py())) for t in texts[at : at + 64]]
                names = ["null.png" if i is None else f"{i}.png" for i in ids[at : at + 64]]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(media, pa.binary())], names=["member", "media"])

    docs.select("doc_id", "text").mapInArrow(encode, "member string, media binary").write.format("media_archive").mode("append").save(path)


def read_media(spark: SparkSession, path: str, **options: int) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, offset long"


def media_features(media: DataFrame) -> DataFrame:
    """FEATURES of each member of media (as read_media gives it), all from the bytes read back."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for m, stored, offset in zip(pdf["member"], pdf["media"], pdf["offset"], strict=True):
                samples, n = from_image(stored)
                raw = np.ascontiguousarray(samples).data.cast("B")
                name = m.removesuffix(".png")
                rows.append((None if name == "null" else int(name), n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples), offset))
            out = pd.DataFrame(rows, columns=[f.split()[0] for f in FEATURES.split(", ")])
            yield out.assign(doc_id=pd.array([r[0] for r in rows], "Int64"))

    return media.mapInPandas(compute, FEATURES)


def media_column(docs: DataFrame) -> DataFrame:
    """FEATURES of every row of docs(doc_id, text): texts go to archives in the shared folder, and come back through the source.

    A null text is an empty one, which is one row of zeros. Repeated rows are members of their
    own; equal texts have equal values but for `offset`. A text of any length is one member. An
    empty table gives no rows. Other columns aren't read. Nothing is shuffled; a task holds
    one batch of texts and one of members.
    """
    path = scratch(docs.sparkSession, "media")
    write_media(docs, path)
    return media_features(read_media(docs.sparkSession, path))


def op6_media(spark, sf_dir: str) -> DataFrame:
    return media_column(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("offset")
