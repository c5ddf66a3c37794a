"""Media columns: payloads as lossless images in archives, written and read by a custom Spark data source.

The writer puts each row's payload into a ZIP archive as a stored member: a PNG image of 8-bit grey samples, 64 wide.
A task writes its own archive; the driver's commit lists the archives that count, so lost or repeated tasks leave no
row behind. The reader plans byte ranges over the archives without opening them; a task reads the directory at the
end of its archive, takes the members whose offset lies in its range, and sends them on in Arrow batches. A member
that fails is read again by its offset, alone.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from storyloom.llm.common import scratch_path

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, media binary"
#: Each commit lists its archives in a file of its own; what can go wrong while a member is read.
MANIFEST, FAILURES = "_archives-", (OSError, ValueError, struct.error, zipfile.BadZipFile)


def payload(text: str | None) -> bytes:
    """UTF-8, padded with bytes 0 to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(data: bytes, n_bytes: int) -> bytes:
    """data, a multiple of 64 bytes, as grey samples; n_bytes, the length without padding, goes into a text chunk."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The samples and n_bytes; raises ValueError where a checksum, the form or the size is wrong."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, n_bytes, height = 8, [], None, 0
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if (width, form) != (WIDTH, [8, 0, 0, 0, 0]):
                raise ValueError("not 8-bit grey, 64 wide")
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) != height * (WIDTH + 1) or raw[:: WIDTH + 1].any():
        raise ValueError("unexpected size or row filter")
    return raw.reshape(height, WIDTH + 1)[:, 1:].tobytes(), height * WIDTH if n_bytes is None else n_bytes


def features(samples: bytes) -> str:
    """Mean, deviation, entropy in bits and number of distinct values of the samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts[counts > 0] / len(samples)
    mean = float((np.arange(256) * counts).sum() / len(samples))
    var = float((np.arange(256) ** 2 * counts).sum() / len(samples)) - mean * mean
    return f"mean={mean:.4f};std={max(var, 0.0) ** 0.5:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};values={len(share)}"


class ByteRange(InputPartition):
    def __init__(self, name: str, lo: int, hi: int):
        self.name, self.lo, self.hi = name, lo, hi


class Archive(WriterCommitMessage):
    def __init__(self, name: str | None, size: int, members: int):
        self.name, self.size, self.members = name, size, members


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range_bytes = options["path"], int(options.get("rangebytes", 32 << 20))
        self.batch_bytes, self.tries = int(options.get("batchbytes", 4 << 20)), int(options.get("tries", 3))

    def partitions(self):
        store, root = fs.FileSystem.from_uri(self.path)
        listed = []
        for manifest in manifests(store, root):
            with store.open_input_stream(manifest) as f:
                listed += json.loads(f.read())
        return [ByteRange(a["name"], lo, min(lo + self.range_bytes, a["size"])) for a in listed for lo in range(0, a["size"], self.range_bytes)] or [ByteRange("", 0, 0)]

    def member(self, store, path: str, info: zipfile.ZipInfo) -> bytes:
        """One member, found by its offset; a failure costs this member another try, no other."""
        for left in range(self.tries - 1, -1, -1):
            try:
                with store.open_input_file(path) as f:
                    return self.take(f, info)
            except FAILURES:
                if not left:
                    raise
        raise AssertionError

    @staticmethod
    def take(f, info: zipfile.ZipInfo) -> bytes:
        f.seek(info.header_offset)
        head = f.read(30)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            raise ValueError(f"no member at {info.header_offset}")
        name, extra = struct.unpack("<HH", head[26:30])
        f.seek(info.header_offset + 30 + name + extra)
        data = f.read(info.compress_size)
        if zlib.crc32(data) != info.CRC:
            raise ValueError(f"the member at {info.header_offset} has a wrong checksum")
        return data

    def directory(self, store, path: str) -> list[zipfile.ZipInfo]:
        """The members that an archive lists; a failed read is tried again."""
        for left in range(self.tries - 1, -1, -1):
            try:
                with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    return z.infolist()
            except FAILURES:
                if not left:
                    raise
        raise AssertionError

    def read(self, partition: ByteRange):
        if not partition.name:
            return
        store, root = fs.FileSystem.from_uri(self.path)
        path = f"{root}/{partition.name}"
        ids, media, held = [], [], 0
        members = [i for i in self.directory(store, path) if partition.lo <= i.header_offset < partition.hi]
        with store.open_input_file(path) as f:
            for info in sorted(members, key=lambda i: i.header_offset):
                try:
                    data = self.take(f, info)
                except FAILURES:
                    data = self.member(store, path, info)
                name = info.filename.split("-", 1)[1].removesuffix(".png")
                ids.append(None if name == "null" else int(name))
                media.append(data)
                held += len(data)
                if held >= self.batch_bytes:
                    yield self.batch(ids, media)
                    ids, media, held = [], [], 0
        if ids:
            yield self.batch(ids, media)

    @staticmethod
    def batch(ids, media):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])


def manifests(store, root: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith(MANIFEST))


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, batches):
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.zip"
        n = 0
        with store.open_output_stream(f"{root}/{name}") as out:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                for b in batches:
                    for doc_id, media in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                        z.writestr(zipfile.ZipInfo(f"{n:08d}-{'null' if doc_id is None else doc_id}.png"), media.as_py())
                        n += 1
            size = out.tell()
        return Archive(name, size, n)

    def commit(self, messages):
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        listed = [{"name": m.name, "size": m.size, "members": m.members} for m in messages if m is not None and m.members]
        before = manifests(store, root) if self.overwrite else []
        with store.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(listed).encode())
        for manifest in before:  # its archives no longer count
            store.delete_file(manifest)

    def abort(self, messages):
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.name}")


class MediaArchives(DataSource):
    """spark.read / df.write.format("media_archives"): doc_id and media from the archives under path."""

    @classmethod
    def name(cls):
        return "media_archives"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MediaReader(dict(self.options))

    def writer(self, schema, overwrite):
        return MediaWriter(dict(self.options), overwrite)


def store_documents(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Each row's text as a member of an archive under path; a null text is an empty one, a null doc_id stays null. Mode `append` keeps what is there, `overwrite` does not."""

    def encode(batches):
        for b in batches:
            texts = [t.as_py() for t in b.column("text")]
            media = [to_png(payload(t), len((t or "").encode("utf-8", "surrogatepass"))) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    docs.sparkSession.dataSource.register(MediaArchives)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain.mapInArrow(encode, SCHEMA).write.format("media_archives").mode(mode).save(path)


def read_media(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(path)


def describe(stored: DataFrame) -> DataFrame:
    """Per member: sizes, digests and features of the samples that its bytes hold."""

    def run(batches):
        for b in batches:
            rows = []
            for m in b.column("media"):
                media = m.as_py()
                samples, n = from_png(media)
                rows.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], NAMES)

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text of docs as media in the shared folder, reads it back and describes it; one row for each row.

    Empty and null texts hold one row of 64 zero samples. Equal texts give equal values; repeated rows are members of
    their own; an empty table gives no row. Only doc_id and text are read.
    """
    path = scratch_path(docs.sparkSession, "media")
    store_documents(docs, path)
    return describe(read_media(docs.sparkSession, path))
