"""Media columns: payloads as lossless 8-bit images in archives, and a data source that reads them by byte ranges.

Each archive is a ZIP file whose members are stored (the images are compressed already), written by one task.
The data source plans byte ranges of the archives on the driver, from file sizes alone; a task reads its archive's
central directory, takes the members that begin in its range, and streams them through Arrow in bounded batches.
A member that can't be read is tried again by its offset, without the others.
"""

from __future__ import annotations

import struct
import time
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import attempt_name, filesystem, pieces, shared_folder, written

WIDTH = 192
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
MEMBER_SCHEMA = "archive string, member string, offset long, payload binary"
RANGE_BYTES = 8 << 20
BATCH_BYTES = 8 << 20


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(raw: bytes) -> bytes:
    """raw with bytes 32 up to a positive multiple of WIDTH."""
    return raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def to_image(raw: bytes, level: int = 2) -> bytes:
    """The padded bytes as a grey 8-bit PNG of WIDTH columns, with the unpadded length in a text chunk."""
    import numpy as np

    full = np.frombuffer(padded(raw), np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(full), WIDTH + 1), np.uint8)
    rows[:, 1:] = full
    head = struct.pack(">IIBBBBB", WIDTH, len(full), 8, 0, 0, 0, 0)
    return PNG_HEAD + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def from_image(image: bytes) -> tuple[bytes, int]:
    """(padded bytes, unpadded length) of an image made by to_image(); checks every chunk's CRC."""
    import numpy as np

    if image[:8] != PNG_HEAD:
        raise ValueError("not a PNG")
    at, data, length, shape = 8, [], None, None
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"tEXt":
            length = int(body.split(b"\0")[1])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    return rows[:, 1:].tobytes(), length


def feature(samples: bytes) -> str:
    """64-bit average hash: the samples in 64 equal runs, a bit for each run whose mean is above the whole's."""
    import numpy as np

    sums = np.frombuffer(samples, np.uint8).reshape(64, -1).sum(axis=1, dtype=np.int64)
    return f"{int(''.join('1' if b else '0' for b in (sums * 64 > sums.sum())), 2):016x}"


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """An archive per task with an image per document, where the documents lie: nothing is shuffled. Returns the manifest (path)."""

    def write(batches):
        import zipfile

        import pyarrow as pa

        archive, n = None, 0
        for batch in pieces(batches, "text"):
            if archive is None:
                fs, base = filesystem(folder)
                draft = f"{base}/{attempt_name('draft', '.part')}"
                sink = fs.open_output_stream(draft)
                archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                archive.writestr(zipfile.ZipInfo(f"{n}/{'' if doc_id is None else doc_id}.png"), to_image((text or "").encode()))
                n += 1
        if archive:
            archive.close()
            sink.close()
            # one name for all attempts of a task: a second attempt replaces the file by the same one
            path = f"media-{TaskContext.get().partitionId():06d}.zip"
            fs.move(draft, f"{base}/{path}")
            yield pa.RecordBatch.from_pydict({"path": [path], "members": pa.array([n], pa.int64())})

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "path string, members long"), "media-manifest")


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def read_member(source, name: str, offset: int, size: int, crc: int, tries: int = 3) -> bytes:
    """The stored member whose local header is at offset; read again, from that offset alone, if it fails."""
    for left in reversed(range(tries)):
        try:
            source.seek(offset)
            head = source.read(30)
            if head[:4] != b"PK\x03\x04":
                raise OSError(f"no member at {offset}")
            source.seek(offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
            data = source.read(size)
            if len(data) != size or zlib.crc32(data) != crc:
                raise OSError(f"{name} at {offset} is damaged")
            return data
        except OSError:
            if not left:
                raise
            time.sleep(0.1)


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self):
        from pyarrow import fs as pafs

        fs, base = filesystem(self.folder)
        prefix = self.folder.rstrip("/")
        ranges = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(base)), key=lambda x: x.path):
            if info.base_name.endswith(".zip"):
                ranges += [ByteRange(f"{prefix}/{info.base_name}", s, min(s + self.range_bytes, info.size)) for s in range(0, info.size, self.range_bytes)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition):
        import zipfile

        import pyarrow as pa

        if not partition.path:
            return
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("payload", pa.binary())])
        fs, at = filesystem(partition.path)
        with fs.open_input_file(at) as source:
            rows, held = [], 0
            for m in zipfile.ZipFile(source).infolist():
                if partition.start <= m.header_offset < partition.end:
                    rows.append((partition.path, m.filename, m.header_offset, read_member(source, m.filename, m.header_offset, m.compress_size, m.CRC)))
                    held += m.compress_size
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``; option range_bytes."""

    @classmethod
    def name(cls):
        return "media_archives"

    def schema(self):
        return MEMBER_SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def features(members: DataFrame) -> DataFrame:
    """Features of the members as stored: see the columns' names; doc_id comes from the member's name."""

    def compute(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            rows = []
            for name, image in zip(batch.column("member").to_pylist(), batch.column("payload").to_pylist()):
                doc_id = name.rsplit("/", 1)[1].removesuffix(".png")
                payload, n = from_image(image)
                rows.append((int(doc_id) if doc_id else None, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return members.mapInArrow(compute, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_features(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Stores each document's UTF-8 bytes (null: empty) as an image in archives, reads them back by the data source, computes features.

    Rows with equal ids, or none, are members of their own. Equal texts give equal values.
    """
    folder = shared_folder(spark, "media")
    write_archives(docs, folder)
    spark.dataSource.register(MediaArchives)
    return features(spark.read.format("media_archives").load(folder))
