"""WARC archives as seekable Zstandard bundles: frames of records, a footer seek table, and record ids mapped to offsets in frames."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from folio.llm.common import scratch, table, written

#: Fixed values of the seekable format: frames to skip, the number at the end of a seek table, its one entry.
SKIPPABLE, INDEX_FRAME, SEEKABLE = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
ENTRY, FOOTER, SKIP = "<II", "<IBI", "<II"
#: Of the index: id, frame, offset in the frame, length.
PLACE = np.dtype([("id", "S16"), ("frame", "<u4"), ("offset", "<u8"), ("length", "<u8")])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, record_id string, record_type string, url string, refers_to string, digest string, payload binary"
PLACES = "archive string, frame int, offset long, length long, record_id string"
MANIFESTS = "_manifests"
#: Base32's digits in the order of their value, and those of the same values in a number of base 32.
BASE32, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Equal rows that one task makes.
CHUNK = 10_000


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column."""
    digest = F.sha1(payload)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]), DIGITS, BASE32)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uuid(key: Column) -> Column:
    """The URN of a record: 128 bits of the hash of its key."""
    h = F.substring(F.sha2(key, 256), 1, 32)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def to_record(r: dict) -> bytes:
    """A WARC record of a row of RECORDS: a response with its payload, or a revisit, which has the header of the response alone."""
    body = r["payload"] or b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % r["size"]
    block += body if r["record_type"] == "response" else b""
    url = re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", r["url"] or "")
    head = {"WARC-Type": r["record_type"], "WARC-Record-ID": f"<{r['record_id']}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{r['digest']}"}
    if r["page_id"] is not None:
        head["X-Page-ID"] = str(r["page_id"])
    if r["record_type"] == "revisit":
        head |= {"WARC-Refers-To": f"<{r['refers_to']}>", "WARC-Profile": PROFILE}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def from_record(raw: bytes | memoryview) -> tuple[dict, int]:
    """The row of RECORDS that a record at the beginning of raw holds, and where the record ends. A response's payload must have its digest."""
    end = bytes(raw[: 1 << 16]).find(b"\r\n\r\n")
    if bytes(raw[:10]) != b"WARC/1.1\r\n" or (end < 0 and (end := bytes(raw).find(b"\r\n\r\n")) < 0):
        raise ValueError("not a record")
    head = dict(line.split(": ", 1) for line in bytes(raw[:end]).decode().split("\r\n")[1:])
    stop = end + 4 + int(head["Content-Length"])
    block = bytes(raw[end + 4 : stop])
    if bytes(raw[stop : stop + 4]) != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
    if payload is not None and _digest(payload) != digest:
        raise ValueError(f"damaged payload of {head['WARC-Record-ID']}")
    page, refers = head.get("X-Page-ID"), head.get("WARC-Refers-To")
    row = {"page_id": page and int(page), "record_id": head["WARC-Record-ID"][1:-1], "record_type": kind, "url": head["WARC-Target-URI"], "refers_to": refers and refers[1:-1], "digest": digest, "payload": payload}
    return row, stop + 4


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Bundle(WriterCommitMessage):
    archive: str
    size: int


class BundleWriter(DataSourceArrowWriter):
    """A task writes one bundle of its own name: frames of about `frame_bytes` of whole records,
    compressed each by itself; a frame to skip with the index, PLACE of each record by id; and the
    seek table, a frame to skip too, with the two sizes of each frame. A commit adds a file to
    the folder of manifests that names the bundles of the tasks that succeeded."""

    def __init__(self, path: str, frame_bytes: int, level: int):
        self.path, self.frame_bytes, self.level = path, frame_bytes, level

    def write(self, batches: Iterator[pa.RecordBatch]) -> Bundle:
        fs, root = _at(self.path)
        fs.create_dir(root, recursive=True)
        name, press = f"part-{uuid.uuid4().hex}.warc.zst", zstandard.ZstdCompressor(level=self.level, write_checksum=True)
        sizes, places, held, n = [], [], [], 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:  # else a name in .zst is compressed once more

            def close() -> None:
                nonlocal held, n
                out.write(frame := press.compress(b"".join(held)))
                sizes.append((len(frame), n))
                held, n = [], 0

            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                    places.append((uuid.UUID(row["record_id"]).bytes, len(sizes), n, len(raw := to_record(row))))
                    held.append(raw)
                    n += len(raw)
                    if n >= self.frame_bytes:
                        close()
            if held:
                close()
            index = press.compress(np.sort(np.array(places, PLACE), order="id").tobytes())
            entries = b"".join(struct.pack(ENTRY, *s) for s in sizes)
            for part in (struct.pack(SKIP, INDEX_FRAME, len(index)), index, struct.pack(SKIP, SKIPPABLE, len(entries) + struct.calcsize(FOOTER)), entries, struct.pack(FOOTER, len(sizes), 0, SEEKABLE)):
                out.write(part)
            size = out.tell()
        return Bundle(name, size)

    def commit(self, messages: list[Bundle | None]) -> None:
        fs, root = _at(self.path)
        fs.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        name = f"{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{root}/{name}.part") as f:
            f.write(json.dumps([[m.archive, m.size] for m in messages if m]).encode())
        fs.move(f"{root}/{name}.part", f"{root}/{MANIFESTS}/{name}")

    def abort(self, messages: list[Bundle | None]) -> None:
        fs, root = _at(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/{m.archive}")


class OpenBundle:
    """Random access to one bundle: begin of each frame and its size, the index, and records by frame and offset."""

    def __init__(self, path: str):
        fs, at = _at(path)
        self.file = fs.open_input_file(at)
        end = self.file.size()
        foot = end - struct.calcsize(FOOTER)
        frames, _, mark = struct.unpack(FOOTER, self.file.read_at(end - foot, foot))
        if mark != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        begin = foot - frames * struct.calcsize(ENTRY)
        sizes = np.frombuffer(self.file.read_at(foot - begin, begin), "<u4").reshape(-1, 2).astype(np.int64)
        self.size, self.table = sizes[:, 0], begin - struct.calcsize(SKIP)
        self.begin = np.cumsum(self.size) - self.size

    def index(self) -> np.ndarray:
        at = int(self.size.sum()) + struct.calcsize(SKIP)
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(self.table - at, at))
        return np.frombuffer(raw, PLACE)

    def frame(self, i: int) -> memoryview:
        return memoryview(zstandard.ZstdDecompressor().decompress(self.file.read_at(int(self.size[i]), int(self.begin[i]))))


@dataclass
class FrameRange(InputPartition):
    """The frames of an archive that begin from start to before end."""

    archive: str
    start: int
    end: int


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), *[(c, pa.string()) for c in ("record_id", "record_type", "url", "refers_to", "digest")], ("payload", pa.binary())])
_PLACE_SCHEMA = pa.schema([("archive", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())])


class BundleReader(DataSourceReader):
    """Records (a partition for each `range_bytes` of an archive), or with `places` the index (one for each archive)."""

    def __init__(self, path: str, range_bytes: int, places: bool):
        self.path, self.range_bytes, self.places = path, range_bytes, places

    def partitions(self) -> list[FrameRange]:
        fs, root = _at(self.path)
        out = []
        for file in sorted(fs.get_file_info(pafs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True)), key=lambda f: f.path):
            with fs.open_input_stream(file.path) as f:
                for archive, size in json.loads(f.read()):
                    step = size if self.places else self.range_bytes
                    out += [FrameRange(archive, at, min(at + step, size)) for at in range(0, size, step)]
        return out or [FrameRange("", 0, 0)]

    def read(self, part: FrameRange) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        bundle = OpenBundle(f"{self.path}/{part.archive}")
        if self.places:
            index = bundle.index()
            for at in range(0, len(index), 10_000):
                yield _batch([(part.archive, int(p["frame"]), int(p["offset"]), int(p["length"]), uuid.UUID(bytes=p["id"].ljust(16, b"\0")).urn) for p in index[at : at + 10_000]], _PLACE_SCHEMA)
            return
        first, last = np.searchsorted(bundle.begin, [part.start, part.end])
        for i in range(first, last):
            raw, at, rows = bundle.frame(i), 0, []
            while at < len(raw):
                row, n = from_record(raw[at:])
                rows.append(tuple(row.values()))
                at += n
            yield _batch(rows, _RECORD_SCHEMA)


class WarcBundle(DataSource):
    """format("warc_bundle"): `path`, frame_bytes (of records in a frame), level, range_bytes (of a partition), places ("true": the index)."""

    @classmethod
    def name(cls) -> str:
        return "warc_bundle"

    def schema(self) -> str:
        return PLACES if self._places() else RECORDS

    def _places(self) -> bool:
        return self.options.get("places", "false") == "true"

    def _n(self, key: str, default: int) -> int:
        return int(self.options.get(key, default))

    def reader(self, schema) -> BundleReader:
        return BundleReader(self.options["path"], self._n("range_bytes", 8 << 20), self._places())

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["path"], self._n("frame_bytes", 1 << 20), self._n("level", 3))


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """RECORDS and `size` (of the payload) for every row of pages(page_id, url, html).

    Of rows with equal payloads of at least least_bytes bytes, that of the largest page_id is the
    response, and the others revisit it. Ties go to the larger url; rows that are repeated
    wholly are told apart by number. A null page_id is less than any other; a null html is
    an empty payload. Payloads are compared by their SHA-1 and size.

    One shuffle of the payloads: a join by digest with the responses' own rows, which are aggregated
    without any payload; both sides are such that Spark may split a payload that many rows have. Where
    rows are repeated wholly, another one for them.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "size": F.octet_length("payload").cast("long")})
    key = F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("p"), F.col("page_id").isNotNull().alias("some"), F.coalesce("url", F.lit("")).alias("u"), F.col("url").isNotNull().alias("url"))
    found = rows.where(F.col("size") >= least_bytes).groupBy("digest", key.alias("k")).agg(F.count("*").alias("same"))
    found = found.groupBy("digest").agg(F.max(F.struct("k", "same")).alias("x"))
    name = lambda k, no: _uuid(F.to_json(F.struct(k.alias("k"), F.col("digest"), no.alias("no"))))
    first = found.select(F.col("digest").alias("d"), F.col("x.k").alias("top"), F.col("x.same").alias("same"), name(F.col("x.k"), F.lit(0)).alias("response"))
    first = written(first, "warc-responses")
    both = rows.join(first, rows["digest"] == first["d"], "left").withColumn("k", key)
    is_top = F.coalesce((F.col("k") == F.col("top")) & (F.col("size") >= least_bytes), F.lit(False))
    # a row that isn't repeated within its digest has a key of its own; the others get random ones
    alone = F.col("same").isNull() | (F.col("size") < least_bytes)
    record = F.when(is_top, F.col("response")).otherwise(_uuid(F.concat(F.lit("copy"), F.expr("uuid()"))))
    kind = F.when(alone | is_top, "response").otherwise("revisit")
    out = lambda df, rid, typ: df.select("page_id", rid.alias("record_id"), typ.alias("record_type"), "url", F.when(typ == "revisit", F.col("response")).alias("refers_to"), "digest", F.when(typ == "response", F.col("payload")).alias("payload"), "size")
    repeated = is_top & (F.col("same") > 1)
    plain = out(both.where(~repeated), record, kind)
    if not first.where("same > 1").limit(1).count():
        return plain
    # rows that repeat the response's own are all alike: one gives its payload, the others are made by number, in chunks
    one = both.where(repeated).groupBy("digest").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "payload", "size", "same", "response")])
    one = written(one, "warc-repeated")
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("same") - 2) / CHUNK).cast("int"))).alias("chunk")
    more = one.drop("payload").select("*", chunk).repartition("digest", "chunk")
    turn = F.explode(F.sequence(F.col("chunk").cast("long") * CHUNK + 1, F.least(F.col("same") - 1, (F.col("chunk") + 1).cast("long") * CHUNK)))
    more = more.select("*", turn.alias("turn")).withColumn("payload", F.lit(None).cast("binary"))
    again = _uuid(F.concat(F.lit("copy"), F.expr("uuid()")))
    return plain.unionByName(out(one, F.col("response"), F.lit("response"))).unionByName(out(more, again, F.lit("revisit")))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, **options: int) -> None:
    """Appends bundles of the `records` of pages under path."""
    pages.sparkSession.dataSource.register(WarcBundle)
    records(pages, least_bytes).write.format("warc_bundle").options(**options).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """RECORDS of the committed bundles under path; every payload is held against its digest."""
    spark.dataSource.register(WarcBundle)
    return spark.read.format("warc_bundle").options(**options).load(path)


def places(spark: SparkSession, path: str) -> DataFrame:
    """PLACES: where each record lies, from the bundles' indexes; no frame is read."""
    spark.dataSource.register(WarcBundle)
    return spark.read.format("warc_bundle").option("places", "true").load(path)


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """RECORDS of wanted(record_id): the ids meet the indexes in a join, and only frames that hold one of them are read, each once."""
    at = places(spark, path).join(wanted.select("record_id").distinct(), "record_id").select("archive", "frame", "offset", "length")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = frame = bundle = raw = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["archive"] != archive:
                    archive, frame, bundle = r["archive"], None, OpenBundle(f"{path}/{r['archive']}")
                if r["frame"] != frame:
                    frame, raw = r["frame"], bundle.frame(r["frame"])
                yield _batch([tuple(from_record(raw[r["offset"] : r["offset"] + r["length"]])[0].values())], _RECORD_SCHEMA)

    return at.repartition("archive", "frame").sortWithinPartitions("archive", "frame", "offset").mapInArrow(read, RECORDS)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for every row of pages(page_id, url, html), from archives in the shared folder.

    Each row becomes a record (see `records` for null ids and texts, ties and repeated rows), and
    is read back through the source. payload_bytes and payload_digest are taken from the payload
    read: a revisit's from that of the response that its WARC-Refers-To names, and
    refers_to is the response's page_id. A html of any length is one record in one frame. An
    empty table gives no rows; other columns aren't read. A task holds one frame and one Arrow batch.
    """
    spark, path = pages.sparkSession, scratch(pages.sparkSession, "warc")
    write_warc(pages, path, least_bytes)
    back = read_warc(spark, path).select("page_id", "record_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("payload").isNotNull(), base32_sha1(F.col("payload"))).alias("payload_digest"))
    back = written(back, "warc-read")
    shared = back.where("record_type = 'response'").select(F.col("record_id").alias("of"), F.col("page_id").alias("refers"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"))
    revisits = back.where("record_type = 'revisit'").join(shared, F.col("refers_to") == F.col("of"))
    whole = back.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return whole.unionByName(revisits.select("page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", F.col("refers").alias("refers_to")))


def op11_warc(spark, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(encode(coalesce(html, ''))) AS h FROM pages),
b AS (SELECT *, list_transform(range(4), lambda i: CAST('0x' || substr(h, CAST(10 * i + 1 AS INT), 10) AS BIGINT)) AS parts,
  row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS k, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS top FROM p)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
  array_to_string(list_transform(parts, lambda x: array_to_string(list_transform(range(8), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> CAST(35 - 5 * j AS INT)) & 31) + 1 AS INT), 1)), '')), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to FROM b
"""
