"""Segment files: writing sealed rows, reading frames and headers, and following a live log.

A log is a folder with audit-NNNN.cbor files; a store is a folder of logs. A task reads whole segments, frame by frame;
a frame that is cut short or whose lengths disagree ends its segment with a torn row instead of an error.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..constants import FORMAT_VERSION, HEADER_BYTES, MAGIC
from ..errors import LogFormatError, SealError

NAME = re.compile(r"audit-(\d{4})\.cbor")
FRAMES = "log_id string, segment_index int, file_offset long, payload_bytes binary, hmac binary, torn boolean"
SEGMENTS = "log_id string, segment_index int, header binary, file_bytes long"


def filesystem(uri: str):
    """(pyarrow file system, path); a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def durable(fs, path: str) -> None:
    """Asks a local file system to keep the file or folder over a power cut; other stores do so when a file is closed."""
    import os

    if fs.type_name == "local":
        handle = os.open(path, os.O_RDONLY)
        try:
            os.fsync(handle)
        finally:
            os.close(handle)


def header(segment_index: int, key_id: bytes, prev_final: bytes) -> bytes:
    body = MAGIC + struct.pack("<HH", FORMAT_VERSION, segment_index) + key_id + prev_final
    return body + struct.pack("<II", zlib.crc32(body), 0)


def frame(payload: bytes, signed: bytes) -> bytes:
    size = struct.pack("<I", len(payload))
    return size + payload + signed + size


def frames_of(data, offset: int = HEADER_BYTES) -> Iterator[tuple[int, bytes | None, bytes | None, bool]]:
    """(offset, payload, hmac, torn) of the frames from offset on; lengths are checked against what is there before use."""
    while offset < len(data):
        size = int.from_bytes(data[offset : offset + 4], "little")
        end = offset + 4 + size + 36
        if offset + 4 > len(data) or end > len(data) or data[end - 4 : end] != data[offset : offset + 4]:
            yield offset, None, None, True
            return
        yield offset, bytes(data[offset + 4 : end - 36]), bytes(data[end - 36 : end - 4]), False
        offset = end


def write_segments(sealed: DataFrame, folder: str, key_id: bytes, token: str | None = None) -> DataFrame:
    """Files of the sealed rows (operators.seal.SEALED) below folder/<log_id>; returns log_id, segment_index, path, bytes.

    Sealed rows come with each log's in one task and in order, and are written there, one record at a time, without
    another shuffle. With a lease's token (sources.lease) a file is put in place only while that is the store's. A file appears by one
    rename when it is whole, under a name that a repeated attempt replaces with equal bytes. Rows of a resumed log go on
    behind the first file_offset bytes of the file that is there.
    """

    def write(batches):
        import pyarrow as pa

        from .lease import check_token

        fs, base = filesystem(folder)
        attempt, out, now, done = TaskContext.get().taskAttemptId(), None, None, []

        def close():
            out.close()
            final = f"{base}/{now[0]}/audit-{now[1]:04d}.cbor"
            durable(fs, f"{final}.{attempt}.part")
            check_token(fs, base, token)
            fs.move(f"{final}.{attempt}.part", final)
            durable(fs, f"{base}/{now[0]}")
            done.append((*now, final, size))

        size = 0
        for batch in batches:
            for log, seg, offset, prev_final, signed, payload in zip(*(batch.column(c).to_pylist() for c in ("log_id", "segment_index", "file_offset", "prev_final", "hmac", "payload_bytes"))):
                if now != (log, seg):
                    if out:
                        close()
                    now, size = (log, seg), HEADER_BYTES
                    fs.create_dir(f"{base}/{log}")
                    out = fs.open_output_stream(f"{base}/{log}/audit-{seg:04d}.cbor.{attempt}.part", compression=None)
                    if offset > HEADER_BYTES:  # a resumed segment: what it has so far comes first
                        with fs.open_input_file(f"{base}/{log}/audit-{seg:04d}.cbor") as before:
                            size = out.write(before.read(offset))
                    else:
                        out.write(header(seg, key_id, prev_final))
                if offset != size:
                    raise SealError(f"rows of log {log} aren't together and in order")
                data = frame(payload, signed)
                out.write(data)
                size += len(data)
        if out:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.string(), pa.int32(), pa.string(), pa.int64()))], ["log_id", "segment_index", "path", "bytes"])

    return sealed.mapInArrow(write, "log_id string, segment_index int, path string, bytes long")


def existing(folder: str):
    """filesystem() of a folder; raises if it is missing."""
    from pyarrow import fs as pafs

    fs, base = filesystem(folder.rstrip("/"))
    if fs.get_file_info(base).type != pafs.FileType.Directory:
        raise LogFormatError(f"no folder {folder}")
    return fs, base


def list_logs(folder: str, place: str = "", deep: bool = True) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
    """(log_id, place below the folder, (segment, bytes) in order) of a log or of a store's, one listed at a time; raises if the folder is missing.

    Of what lies at a place only, and without the folders in it if not deep.
    """
    from pyarrow import fs as pafs

    fs, base = existing(folder)
    ahead = [place]
    while ahead:
        place = ahead.pop()
        files, folders = [], []
        for info in fs.get_file_info(pafs.FileSelector(f"{base}/{place}".rstrip("/"), allow_not_found=True)):
            if info.type == pafs.FileType.Directory:
                if deep:
                    folders.append(f"{place}/{info.base_name}".lstrip("/"))
            elif info.type == pafs.FileType.File and (m := NAME.fullmatch(info.base_name)):
                files.append((int(m[1]), info.size))
        if files:
            yield place or base.rsplit("/", 1)[1], place, sorted(files)
        ahead += sorted(folders, reverse=True)


def segment_path(folder: str, place: str, segment: int) -> str:
    return f"{folder.rstrip('/')}/{place}{'/' if place else ''}audit-{segment:04d}.cbor"


def list_segments(folder: str) -> list[tuple[str, int, str, int]]:
    """(log_id, segment, path, bytes) of a log's or a store's files, in order; for stores of few files, others take list_logs()."""
    return sorted((log, seg, segment_path(folder, place, seg), size) for log, place, files in list_logs(folder) for seg, size in files)


class SegmentRun(NamedTuple):
    """Segments of a log that follow each other: from ``begin`` in the first to ``stop`` in the last, whole ones between."""

    log_id: str
    place: str
    first: int
    begin: int
    last: int
    stop: int


class SegmentRuns(InputPartition):
    """Runs that one task reads: small ones together."""

    def __init__(self, runs: list[SegmentRun]):
        self.runs = runs

    @property
    def segment(self) -> int:
        return self.runs[0].first


#: Bytes of a task's segments, each counting for some more, as opening it costs something; of a run. So few segments get a
#: task each, and there are about so many tasks at most.
TASK_BYTES, OPEN_BYTES, RUN_BYTES, FEW, MOST_TASKS = 32 << 20, 64 << 10, 1 << 20, 64, 2000


def in_tasks(segments: Iterator[SegmentRun], headers: bool = False) -> list[SegmentRuns]:
    """Tasks of runs of one segment each, which come log by log in order. What is kept of a log's segments is a row a run, not a row a segment."""
    cost = lambda r: OPEN_BYTES + (0 if headers else r.stop - r.begin)
    few = list(itertools.islice(segments, FEW + 1))
    if len(few) <= FEW:
        return [SegmentRuns([r]) for r in few]
    runs: list[SegmentRun] = []
    costs = array("q")
    for r in itertools.chain(few, segments):
        last = runs[-1] if runs else None
        if last and (last.place, last.last + 1, HEADER_BYTES) == (r.place, r.first, r.begin) and costs[-1] + cost(r) <= RUN_BYTES:
            runs[-1] = last._replace(last=r.last, stop=r.stop)
            costs[-1] += cost(r)
        else:
            runs.append(r)
            costs.append(cost(r))
    most, out, size = max(TASK_BYTES, sum(costs) // MOST_TASKS), [], 0
    for run, n in zip(runs, costs):
        if not out or size + n > most:
            out.append(SegmentRuns([]))
            size = 0
        out[-1].runs.append(run)
        size += n
    return out


def opened(folder: str, runs: list[SegmentRun]) -> Iterator[tuple]:
    """(log_id, segment, file, begin, end) of each segment of the runs, open while it is the iterator's turn."""
    for r in runs:
        for seg in range(r.first, r.last + 1):
            fs, at = filesystem(segment_path(folder, r.place, seg))
            with fs.open_input_file(at) as source:
                yield r.log_id, seg, source, r.begin if seg == r.first else HEADER_BYTES, r.stop if seg == r.last else source.size()


class SegmentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.kind = options["path"], options.get("rows", "frames")
        self.low, self.high = int(options.get("first_segment", 0)), int(options.get("last_segment", 1 << 16))

    def partitions(self):
        found = (SegmentRun(log, place, seg, HEADER_BYTES, seg, size) for log, place, files in list_logs(self.folder) for seg, size in files if self.low <= seg <= self.high)
        return in_tasks(found, self.kind == "segments") or [SegmentRuns([])]

    def read(self, partition):
        from .ranges import frames_between

        for log, seg, source, begin, _ in opened(self.folder, partition.runs):
            if self.kind == "segments":
                yield log, seg, source.read(HEADER_BYTES), source.size()
                continue
            for offset, payload, signed, torn in frames_between(source, begin, source.size()):
                yield log, seg, offset, payload, signed, torn


def _placed(offset: str | None, otherwise: tuple[int, int]) -> tuple[int, int]:
    if offset is None:
        return otherwise
    segment, _, at = offset.partition(":")
    return int(segment), int(at)


class SegmentStream(DataSourceStreamReader):
    """Follows a live store. A log's offset is its last segment and how far whole frames of it were read.

    Earlier segments are retired: they are read to their end once, and never looked at again. Each trigger lists the files,
    log by log; of a log it opens the last file, if that grew, and walks the heads of the frames that are new. A frame that
    isn't whole yet waits. What the driver holds is an offset a log.
    With max_bytes_per_trigger a batch takes about so many bytes of each log at most, so a backlog is worked off in steps
    (an availableNow run then takes one step; the first batch after a restart isn't limited, as its start isn't known yet).
    """

    def __init__(self, options: dict):
        self.folder, self.limit = options["path"], int(options.get("max_bytes_per_trigger", 0))
        self.at: dict[str, str] = {}
        self.known_start = False
        #: The size up to which a log's segment at its offset was looked through.
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self):
        self.known_start = True
        return {}

    def latestOffset(self):
        limit = self.limit if self.known_start else 0
        for log, place, files in list_logs(self.folder):
            seg, offset = _placed(self.at.get(log), (files[0][0], HEADER_BYTES))
            room = limit or None
            for n, size in files if limit else files[-1:]:
                if n < seg or room is not None and room <= 0:
                    continue
                if n > seg:
                    seg, offset = n, HEADER_BYTES
                if self.seen.get(log) != (n, size):
                    end = self._whole(segment_path(self.folder, place, n), size, offset, room)
                    room = None if room is None else room - (end - offset)
                    if room is None or room > 0:
                        self.seen[log] = (n, size)
                    offset = end
            self.at[log] = f"{seg}:{offset}"
        self.known_start = True
        return dict(sorted(self.at.items()))

    def _whole(self, path: str, size: int, offset: int, room: int | None) -> int:
        """The end of the whole frames behind offset, or of as many as there is room for."""
        fs, at = filesystem(path)
        stop = size if room is None else offset + room
        with fs.open_input_file(at) as source:
            while offset + 4 <= size and offset < stop:
                source.seek(offset)
                end = offset + 40 + int.from_bytes(source.read(4), "little")
                if end > size:
                    break
                offset = end
        return offset

    def partitions(self, start: dict, end: dict):
        start, end = (json.loads(x) if isinstance(x, str) else x for x in (start, end))
        for log, offset in end.items():
            if log not in self.at or _placed(self.at[log], (0, 0)) < _placed(offset, (0, 0)):
                self.at[log] = offset
        self.known_start = True
        return in_tasks(self._between(start, end))

    def _between(self, start: dict, end: dict) -> Iterator[SegmentRun]:
        for log, place, files in list_logs(self.folder):
            last, stop = _placed(end.get(log), (-1, 0))
            first, begin = _placed(start.get(log), (-1, HEADER_BYTES))
            for seg, size in files:
                if first <= seg <= last:
                    here = SegmentRun(log, place, seg, begin if seg == first else HEADER_BYTES, seg, stop if seg == last else size)
                    if here.begin < here.stop:
                        yield here

    def read(self, partition):
        from .ranges import frames_between

        for log, seg, source, begin, stop in opened(self.folder, partition.runs):
            for offset, payload, signed, torn in frames_between(source, begin, stop):
                yield log, seg, offset, payload, signed, torn


class AuditLogs(DataSource):
    """``format("audit_logs")``; options: rows (frames, the default, or segments: headers), first_segment and last_segment.

    Files are pruned by these options and not by pushed filters: Spark keeps a relation's planned partitions, so a
    filter that pruned them in one query would still do so in the next.
    """

    @classmethod
    def name(cls):
        return "audit_logs"

    def schema(self):
        return SEGMENTS if self.options.get("rows") == "segments" else FRAMES

    def reader(self, schema):
        return SegmentReader(self.options)

    def streamReader(self, schema):
        return SegmentStream(self.options)

    def streamWriter(self, schema, overwrite):
        from .sink import SegmentSink

        return SegmentSink(self.options)


def read_log(spark: SparkSession, folder: str, first_segment: int = 0, last_segment: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """(frames, segments) of a log or store, for operators.verify and operators.query; of some of its segments only.

    Files are listed in tasks; a source of format("audit_logs") gives the same rows, but has the driver deal them.
    """
    from .ranges import read_files, segment_files

    spark.dataSource.register(AuditLogs)
    files = segment_files(spark, folder, dealt_by_file=True)
    return read_files(files.filter(f"segment_index between {first_segment} and {last_segment}"))
