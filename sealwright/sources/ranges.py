"""Byte ranges of segments as rows: what to read is a DataFrame, planned and filtered by Spark, and tasks read just that.

An index is a Parquet table below _index with a row per some 256 kB of whole frames: where they lie, their record ids and
times, their actors and events (or Bloom filters of them where these are many). It is a hint for reading: rows count only
while their file has the size it had, and whatever isn't indexed is read whole.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import HEADER_BYTES
from ..functions import cbor
from ..functions.expressions import glob
from ..functions.records import parsed
from .segments import FRAMES, SEGMENTS, existing, filesystem, frames_of, list_logs, segment_path

SEGMENT_FILES = "log_id string, segment_index int, path string, file_bytes long"
INDEX = f"{SEGMENT_FILES}, start long, end long, frames long, first_record_id decimal(20,0), last_record_id decimal(20,0), first_ts string, last_ts string, actors array<string>, events array<string>, actors_bloom binary, events_bloom binary"
INDEX_FOLDER = "_index"
#: Bytes of frames of an index row; distinct values listed in it; bytes and bits a value of its Bloom filters.
EVERY, LISTED, BLOOM_BYTES, BLOOM_BITS = 256 << 10, 32, 512, 4
FILE_COLUMNS = [x.split()[0] for x in SEGMENT_FILES.split(", ")]
#: Frames are read in pieces of at least this many bytes.
PIECE = 4 << 20


def segment_files(spark: SparkSession, folder: str, dealt_by_file: bool = False) -> DataFrame:
    """A row a segment file. A task lists the folder itself and others the logs in it, so no listing passes through the driver.

    Each use of the rows lists anew. They come from an RDD, whose size Spark takes for unknown, so that no join broadcasts
    them by what their folders' names would let it expect. Those that are dealt by file are ready to be read.
    """
    existing(folder)

    def places(_):
        from pyarrow import fs as pafs

        fs, base = existing(folder)
        yield 0, ""
        for found in fs.get_file_info(pafs.FileSelector(base)):
            if found.type == pafs.FileType.Directory:
                yield zlib.crc32(found.base_name.encode()), found.base_name

    def files(dealt):
        for _, place in dealt:
            for log, at, found in list_logs(folder, place, place != ""):
                for seg, size in found:
                    yield log, seg, segment_path(folder, at, seg), size

    context = spark.sparkContext
    found = context.parallelize([0], 1).mapPartitions(places).partitionBy(context.defaultParallelism * 4, int).mapPartitions(files)
    if dealt_by_file:
        found = found.map(lambda f: (zlib.crc32(f[2].encode()), f)).partitionBy(context.defaultParallelism * 4, int).values()
    return spark.createDataFrame(found, SEGMENT_FILES, verifySchema=False)


def _spread(files: DataFrame) -> DataFrame:
    by = [c for c in ("path", "start") if c in files.columns]
    return files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4), *by)


def frames_between(source, start: int, end: int):
    """(offset, payload, hmac, torn) of the frames that start in [start, end), read a piece at a time; the last may end behind it."""
    size, at, base, data = source.size(), start, start, b""

    def at_hand(n: int) -> bool:
        nonlocal base, data
        if at + n > size:
            return False
        if at + n > base + len(data):
            source.seek(at)
            data, base = source.read(min(max(n, min(PIECE, end - at)), size - at)), at
        return True

    while at < end:
        whole = at_hand(4)
        if whole:
            n = int.from_bytes(data[at - base : at - base + 4], "little")
            whole = at_hand(n + 40)
        i = at - base
        if not whole or data[i : i + 4] != data[i + n + 36 : i + n + 40]:
            yield at, None, None, True
            return
        yield at, bytes(data[i + 4 : i + 4 + n]), bytes(data[i + 4 + n : i + 36 + n]), False
        at += n + 40


def _frames(batches):
    """FRAMES of rows with log_id, segment_index, path, start and end, as a mapInArrow function."""
    import pyarrow as pa

    names = [x.split()[0] for x in FRAMES.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
    made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
    out, held = [], 0
    for batch in batches:
        for log, seg, path, start, end in zip(*(batch.column(c).to_pylist() for c in ("log_id", "segment_index", "path", "start", "end"))):
            fs, at = filesystem(path)
            with fs.open_input_file(at) as source:
                for frame in frames_between(source, start, end):
                    out.append((log, seg, *frame))
                    held += 200 + len(frame[1] or b"")
                    if held >= PIECE:
                        yield made(out)
                        out, held = [], 0
    if out:
        yield made(out)


def read_ranges(ranges: DataFrame) -> DataFrame:
    """FRAMES of rows with log_id, segment_index, path, start and end; a range starts and ends between frames."""
    return _spread(ranges.select("log_id", "segment_index", "path", "start", "end")).mapInArrow(_frames, FRAMES)


def read_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(FRAMES, SEGMENTS) of segment_files() that are dealt by file."""

    def headers(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                fs, at = filesystem(path)
                with fs.open_input_file(at) as source:
                    found.append((source.read(HEADER_BYTES), source.size()))
            if found:
                read, sizes = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column("log_id"), batch.column("segment_index"), pa.array(read, pa.binary()), pa.array(sizes, pa.int64())], names)

    whole = files.select("log_id", "segment_index", "path", F.lit(HEADER_BYTES).cast("long").alias("start"), F.col("file_bytes").alias("end"))
    return whole.mapInArrow(_frames, FRAMES), files.mapInArrow(headers, SEGMENTS)


def bloom_places(value: str) -> list[tuple[int, int]]:
    """(byte, bit) of a value in a filter."""
    h = hashlib.md5(value.encode()).digest()
    return [divmod(int.from_bytes(h[4 * i : 4 * i + 4], "little") % (8 * BLOOM_BYTES), 8) for i in range(BLOOM_BITS)]


def bloom(values) -> bytes:
    out = bytearray(BLOOM_BYTES)
    for v in values:
        for byte, bit in bloom_places(v):
            out[byte] |= 1 << bit
    return bytes(out)


def in_bloom(data: Column, value: str) -> Column:
    out = F.lit(True)
    for byte, bit in bloom_places(value):
        out &= F.conv(F.hex(F.substring(data, byte + 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(1 << bit)) != 0
    return out


def index_rows(files: DataFrame, every: int = EVERY) -> DataFrame:
    """INDEX rows of whole segments; what lies behind the first frame that is torn or doesn't decode gets none."""

    def rows(path: str):
        fs, at = filesystem(path)
        with fs.open_input_file(at) as source:
            held, start, ends = [], HEADER_BYTES, HEADER_BYTES
            for offset, payload, _, torn in frames_between(source, HEADER_BYTES, source.size()):
                record = None if torn else cbor.decode_record(payload)[0]
                if record is None:
                    break
                held.append(record)
                ends = offset + len(payload) + 40
                if ends - start >= every:
                    yield start, ends, held
                    held, start = [], ends
            if held:
                yield start, ends, held

    def listed(values: set):
        return (sorted(values), None) if len(values) <= LISTED else (None, bloom(values))

    def index(batches):
        import decimal

        import pyarrow as pa

        names = ["log_id", "segment_index", "path", "file_bytes", "start", "end", "frames", "first_record_id", "last_record_id", "first_ts", "last_ts", "actors", "events", "actors_bloom", "events_bloom"]
        kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 4, *[pa.decimal128(20, 0)] * 2, pa.string(), pa.string(), *[pa.list_(pa.string())] * 2, pa.binary(), pa.binary()]
        for batch in batches:
            for log, seg, path, size in zip(*(batch.column(c).to_pylist() for c in ("log_id", "segment_index", "path", "file_bytes"))):
                for start, end, held in rows(path):
                    (actors, actors_bloom), (events, events_bloom) = (listed({r[k] for r in held}) for k in (6, 7))
                    ids, times = [decimal.Decimal(r[1]) for r in held], [r[3] for r in held]
                    row = (log, seg, path, size, start, end, len(held), min(ids), max(ids), min(times), max(times), actors, events, actors_bloom, events_bloom)
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    return _spread(files).mapInArrow(index, INDEX)


def build_index(spark: SparkSession, folder: str, every: int = EVERY) -> DataFrame:
    """Indexes the segments that are new or have another size than in the index, and returns the whole of it."""
    files, had = segment_files(spark, folder), read_index(spark, folder)
    new = files if had is None else files.join(had.select("path", "file_bytes").distinct(), ["path", "file_bytes"], "left_anti")
    index_rows(new, every).write.mode("append").parquet(f"{folder.rstrip('/')}/{INDEX_FOLDER}")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame | None:
    from pyarrow import fs as pafs

    fs, base = filesystem(folder)
    if fs.get_file_info(f"{base.rstrip('/')}/{INDEX_FOLDER}/_SUCCESS").type != pafs.FileType.File:
        return None
    return spark.read.schema(INDEX).parquet(f"{folder.rstrip('/')}/{INDEX_FOLDER}")


@dataclass(frozen=True)
class Wanted:
    """What a reader asks for: start <= record_id < end, ts_from <= ts_wall < ts_to, and actors and events by value or pattern."""

    log_id: str | None = None
    segment_index: int | None = None
    start: int | None = None
    end: int | None = None
    actor: str | None = None
    actor_contains: str | None = None
    event: str | None = None
    event_glob: str | None = None
    ts_from: str | None = None
    ts_to: str | None = None

    def files(self) -> Column:
        """Files that may have such records."""
        out = F.lit(True)
        for c in ("log_id", "segment_index"):
            if (value := getattr(self, c)) is not None:
                out &= F.col(c) == value
        return out

    def blocks(self) -> Column:
        """Rows of an index that may have such records."""
        out = self.files()
        for value, condition in ((self.start, lambda v: F.col("last_record_id") >= v), (self.end, lambda v: F.col("first_record_id") < v), (self.ts_from, lambda v: F.col("last_ts") >= v), (self.ts_to, lambda v: F.col("first_ts") < v)):
            if value is not None:
                out &= condition(value)
        for name, value in (("actors", self.actor), ("events", self.event)):
            if value is not None:
                out &= F.coalesce(F.array_contains(name, value), in_bloom(F.col(f"{name}_bloom"), value))
        if self.actor_contains is not None:
            out &= F.coalesce(F.exists("actors", lambda a: F.contains(a, F.lit(self.actor_contains))), F.lit(True))
        if self.event_glob is not None:
            out &= F.coalesce(F.exists("events", lambda e: glob(e, self.event_glob)), F.lit(True))
        return out

    def records(self) -> Column:
        """Such records, by their parsed fields."""
        out = self.files()
        for value, condition in ((self.start, lambda v: F.col("record_id") >= v), (self.end, lambda v: F.col("record_id") < v), (self.ts_from, lambda v: F.col("ts_wall") >= v), (self.ts_to, lambda v: F.col("ts_wall") < v), (self.actor, lambda v: F.col("actor") == v), (self.event, lambda v: F.col("event") == v), (self.actor_contains, lambda v: F.contains("actor", F.lit(v))), (self.event_glob, lambda v: glob(F.col("event"), v))):
            if value is not None:
                out &= condition(value)
        return out


def ranges(spark: SparkSession, folder: str, wanted: Wanted = Wanted()) -> DataFrame:
    """Ranges to read: the index's that may have what is wanted, and all of the files that the index doesn't cover."""
    files, index = segment_files(spark, folder).filter(wanted.files()), read_index(spark, folder)
    if index is None:
        return files.select("*", F.lit(HEADER_BYTES).cast("long").alias("start"), F.col("file_bytes").alias("end"))
    # indexing that was repeated gives equal rows; the files are listed once, so that both kinds of ranges are of one listing
    blocks = index.filter(wanted.files()).dropDuplicates([*FILE_COLUMNS, "start"]).groupBy(*FILE_COLUMNS)
    blocks = blocks.agg(F.max("end").alias("covered"), F.collect_list(F.when(wanted.blocks(), F.struct("start", "end"))).alias("blocks"))
    from_here = F.coalesce("covered", F.lit(HEADER_BYTES).cast("long"))
    rest = F.when(F.col("covered").isNull() | (F.col("covered") < F.col("file_bytes")), F.array(F.struct(from_here.alias("start"), F.col("file_bytes").alias("end"))))
    none = F.array().cast("array<struct<start:long,end:long>>")
    return files.join(blocks, FILE_COLUMNS, "left").select(*FILE_COLUMNS, F.inline(F.concat(F.coalesce("blocks", none), F.coalesce(rest, none))))


def reachable(files: DataFrame) -> DataFrame:
    """Of each log's files those that reading one after the other from segment 0 comes to: up to the first missing index."""
    place = F.row_number().over(Window.partitionBy("log_id").orderBy("segment_index")) - 1
    return files.withColumn("__place", place).filter("__place = segment_index").drop("__place")


def find(spark: SparkSession, folder: str, wanted: Wanted) -> DataFrame:
    """The wanted records of a log's or a store's files, parsed; only ranges that may have some are read."""
    return parsed(read_ranges(ranges(spark, folder, wanted)).filter("not torn")).filter(wanted.records())


TAILS = f"{SEGMENT_FILES}, records decimal(20,0), file_offset long, payload_bytes binary, hmac binary"


def tail_frames(files: DataFrame) -> DataFrame:
    """TAILS: the last whole frame of each segment, found from the file's end by its trailer; its record id tells the count.

    Where the end isn't a frame's, or its record doesn't decode, the segment is read from the start; an empty one has nulls.
    """

    def last(source) -> tuple | None:
        size = source.size()
        if size >= HEADER_BYTES + 40:
            source.seek(size - 4)
            start = size - 40 - int.from_bytes(source.read(4), "little")
            if start >= HEADER_BYTES:
                source.seek(start)
                _, payload, signed, torn = next(frames_of(source.read(size - start), 0))
                record = None if torn else cbor.decode_record(payload)[0]
                if record:
                    return record[1] + 1, start, payload, signed
        found = None
        for n, (offset, payload, signed, torn) in enumerate(frames_between(source, HEADER_BYTES, size)):
            if not torn:
                found = (n + 1, offset, payload, signed)
        return found

    def read(batches):
        import decimal

        import pyarrow as pa

        names = ["log_id", "segment_index", "path", "file_bytes", "records", "file_offset", "payload_bytes", "hmac"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.decimal128(20, 0), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names[:4])):
                fs, at = filesystem(row[2])
                with fs.open_input_file(at) as source:
                    n, *rest = last(source) or (0, None, None, None)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*row, decimal.Decimal(n), *rest), kinds)], names)

    return _spread(files).mapInArrow(read, TAILS)
