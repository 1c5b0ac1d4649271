"""Media columns: texts stored as greyscale images in archives, read back through a Spark data source.

Write: every task packs its members into archive files of bounded size in a
folder that driver and executors share.  A member is a small header, then a
PNG whose 8-bit samples are the payload (64 samples a row), so the stored form
is lossless and compressed.  Each archive has an index of member offsets
beside it, and a task reports the archives it finished; what a lost or
repeated attempt leaves behind is in no report and is never read.

Read: ``spark.read.format("wayfarer_archive")`` plans byte-range partitions over the
archives of the report; a partition streams the members that begin in its range
as Arrow batches of bounded size.  A member that fails to read is retried on
its own, by its offset, with the file opened anew.

Defined results: null texts are empty; an empty payload is 64 zero bytes; a
null id stays null; repeated rows are members of their own; extra columns are
not stored.  Equal texts give equal bytes.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common as C

WIDTH = 64
#: Bytes after which a task begins another archive; bytes of a range that one read task takes; bytes of a batch.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 64 << 20, 8 << 20, 4 << 20
RETRIES = 4
_SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
_HEAD = struct.Struct("<4sBqqq")  # mark, id is null, id, unpadded bytes, bytes of the image
_MARK = b"WFM1"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes) -> bytes:
    """An 8-bit greyscale PNG of 64 samples a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row's filter type, 0, comes first
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.data, 1)) + _chunk(b"IEND", b"")


def decode_image(data: bytes) -> bytes:
    """The samples of such an image."""
    if data[:8] != _SIGNATURE:
        raise OSError("not an image")
    at, parts, width, height = 8, [], 0, 0
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise OSError(f"damaged chunk at {at}")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Archive:
    """One archive file being written, with its index."""

    def __init__(self, folder: str):
        self.name = f"a{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        self.files, root = _place(folder)
        self.path = f"{root}/{self.name}"
        self.out = self.files.open_output_stream(f"{self.path}.bin", compression=None)
        self.at: list[int] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        image = encode_image(text + b"\0" * (-len(text) % WIDTH or (0 if text else WIDTH)))
        head = _HEAD.pack(_MARK, doc_id is None, doc_id or 0, len(text), len(image))
        self.at.append(self.size)
        self.out.write(head)
        self.out.write(image)
        self.size += len(head) + len(image)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        with self.files.open_output_stream(f"{self.path}.idx", compression=None) as f:
            f.write(np.array([*self.at, self.size], "<i8").tobytes())
        return self.name, self.size, len(self.at)


def store(docs: DataFrame, folder: str) -> None:
    """Archive the texts of ``docs`` (doc_id, text) in ``folder``, a URI."""
    files, root = _place(folder)
    files.create_dir(root, recursive=True)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive = [], None
        for batch in batches:
            raw, off = C.flatten(batch.column("text"))
            data = raw.tobytes()
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                archive = archive or _Archive(folder)
                archive.add(doc_id, data[off[i] : off[i + 1]])
                if archive.size >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("name", "size", "members"), x, strict=True)) for x in done], pa.schema([("name", pa.string()), ("size", pa.int64()), ("members", pa.int64())]))

    report = C.small_batches(docs).select("doc_id", "text").mapInArrow(C.trimmed(pack), "name string, size long, members long")
    report.write.json(f"{folder}/report")


class _Range(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.step = int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[_Range]:
        """Byte ranges over the archives that the report names: a line per archive, not per member."""
        files, root = _place(self.folder)
        out = []
        for info in files.get_file_info(fs.FileSelector(f"{root}/report")):
            if info.base_name.startswith("part-"):
                with files.open_input_stream(info.path) as f:
                    for line in f.read().decode().splitlines():
                        row = json.loads(line)
                        out += [_Range(row["name"], a, min(a + self.step, row["size"])) for a in range(0, row["size"], self.step)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, root = _place(self.folder)
        path = f"{root}/{partition.name}"
        with files.open_input_stream(f"{path}.idx") as f:
            at = np.frombuffer(f.read(), "<i8")
        i, j = np.searchsorted(at[:-1], [partition.start, partition.end])
        rows: list[dict] = []
        size = 0
        self.file = None
        for k in range(i, j):
            rows.append(self._member(files, f"{path}.bin", int(at[k]), int(at[k + 1] - at[k])))
            size += 2 * len(rows[-1]["payload"])
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    def _member(self, files: fs.FileSystem, path: str, offset: int, size: int) -> dict:
        """One member by its offset; a failed attempt reopens the file and touches no other member."""
        for attempt in range(RETRIES):
            try:
                if self.file is None:
                    self.file = files.open_input_file(path)
                data = self.file.read_at(size, offset)
                mark, null, doc_id, n, length = _HEAD.unpack_from(data)
                if mark != _MARK or len(data) != _HEAD.size + length:
                    raise OSError(f"no member at {offset} of {path}")
                image = data[_HEAD.size :]
                return {"doc_id": None if null else doc_id, "n_bytes": n, "payload": decode_image(image), "media": image}
            except (OSError, zlib.error, struct.error):
                self.file = None
                if attempt + 1 == RETRIES:
                    raise
                time.sleep(0.05 * 2**attempt)
        raise AssertionError


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary())])


class ArchiveSource(DataSource):
    """Members of media archives: options path (the folder) and rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "wayfarer_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, payload binary, media binary"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_archives(spark, folder: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("wayfarer_archive").option("path", folder).load()


def described(members: DataFrame) -> DataFrame:
    """Digests and features of members, computed on the samples read back."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for payload, media in zip(batch.column("payload").to_pylist(), batch.column("media").to_pylist(), strict=True):
                x = np.frombuffer(payload, np.uint8)
                bars = np.bincount(x >> 5, minlength=8)
                p = np.bincount(x, minlength=256) / len(x)
                p = p[p > 0]
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-WIDTH:]))
                out["media_bytes"].append(len(media))
                out["media_sha256"].append(hashlib.sha256(media).hexdigest())
                out["feature"].append(f"{WIDTH}x{len(x) // WIDTH} mean={x.mean():.4f} entropy={-(p * np.log2(p)).sum():.4f} bars={','.join(map(str, bars))}")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(out["payload_bytes"], pa.int64()), pa.array(out["payload_sha256"], pa.string()), pa.array(out["tail_crc32"], pa.int64()), pa.array(out["media_bytes"], pa.int64()), pa.array(out["media_sha256"], pa.string()), pa.array(out["feature"], pa.string())], ["doc_id", "n_bytes", *out])

    return members.mapInArrow(C.trimmed(describe), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media(docs: DataFrame) -> DataFrame:
    """Stores every text, reads it back and describes it."""
    spark = docs.sparkSession
    folder = f"{C.shared_dir(spark)}/media/{uuid.uuid4().hex}"
    store(docs.select("doc_id", "text"), folder)
    return described(read_archives(spark, folder))
