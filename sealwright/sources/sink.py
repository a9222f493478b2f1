"""The streaming sink of segment files: parts by tasks, epochs decided by a manifest, files put in place by renames.

A task writes each segment that its rows go to as a part below _sealed/parts: what the segment has so far, up to the file
offset of the first row, and the rows' frames. commit() first writes the epoch's manifest (the place, length and last HMAC of
each part), which decides the epoch, and then renames its parts to the segments. A stream that ends in between finds the
manifest when Spark replays the epoch: the replay must give the same, and its parts are renamed, whether or not some were
before. Without a manifest nothing of the epoch shows, and the replay is the epoch. So readers see whole epochs of a log,
each once, and a restarted stream leaves equal bytes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql.datasource import DataSourceStreamArrowWriter, WriterCommitMessage

from ..constants import HEADER_BYTES
from ..errors import LogFormatError, SealError
from .segments import durable, filesystem, frame, header

PARTS, EPOCHS = "_sealed/parts", "_sealed/epochs"


@dataclass(frozen=True)
class Part:
    """A segment as of an epoch: its bytes lie in ``name`` until they are renamed; ``head`` is its last HMAC in hex."""

    log_id: str
    segment_index: int
    start: int
    length: int
    head: str
    name: str

    def place(self) -> tuple:
        return self.log_id, self.segment_index, self.start, self.length, self.head


@dataclass
class Written(WriterCommitMessage):
    parts: list[Part]


def segment_path(base: str, log_id: str, segment_index: int) -> str:
    return f"{base}/{log_id}/audit-{segment_index:04d}.cbor"


class SegmentSink(DataSourceStreamArrowWriter):
    """Rows are operators.seal.SEALED as seal_stream() gives them: a log's rows in one task, one after the other, in order."""

    def __init__(self, options: dict):
        self.folder, self.key_id = options["path"], bytes.fromhex(options["key_id"])

    def write(self, iterator) -> Written:
        fs, base = filesystem(self.folder)
        fs.create_dir(f"{base}/{PARTS}")
        parts: list[Part] = []
        seen: set[tuple] = set()
        now = out = None
        start = size = 0
        name, last = "", b""

        def close():
            out.close()
            durable(fs, f"{base}/{PARTS}/{name}")
            parts.append(Part(*now, start, size, last.hex(), name))

        for batch in iterator:
            for log, seg, offset, prev_final, signed, payload in zip(*(batch.column(c).to_pylist() for c in ("log_id", "segment_index", "file_offset", "prev_final", "hmac", "payload_bytes"))):
                if now != (log, seg):
                    if out:
                        close()
                    if (log, seg) in seen:
                        raise SealError(f"the rows of log {log} aren't together")
                    now, start, name = (log, seg), offset, uuid.uuid4().hex
                    seen.add(now)
                    out = fs.open_output_stream(f"{base}/{PARTS}/{name}", compression=None)
                    if offset > HEADER_BYTES:
                        with fs.open_input_file(segment_path(base, log, seg)) as before:
                            if before.size() < offset:
                                raise LogFormatError(f"segment {seg} of log {log} is shorter than the stream's state says")
                            out.write(before.read(offset))
                    else:
                        out.write(header(seg, self.key_id, prev_final))
                    size = offset
                data = frame(payload, signed)
                out.write(data)
                size, last = size + len(data), signed
        if out:
            close()
        return Written(parts)

    def commit(self, messages: list, batchId: int) -> None:
        new = [p for m in messages if m for p in m.parts]
        decided = self.epoch(batchId)
        if decided is None:
            self.decide(batchId, new)
        elif sorted(p.place() for p in decided) != sorted(p.place() for p in new):
            raise SealError(f"epoch {batchId} was committed with other rows")
        self.put_in_place(new)
        self.clear()

    def abort(self, messages: list, batchId: int) -> None:
        fs, base = filesystem(self.folder)
        for p in (p for m in messages if m for p in m.parts):
            if self._is_file(fs, f"{base}/{PARTS}/{p.name}"):
                fs.delete_file(f"{base}/{PARTS}/{p.name}")

    def epoch(self, batch_id: int) -> list[Part] | None:
        """The parts of a decided epoch, or None."""
        fs, base = filesystem(self.folder)
        path = f"{base}/{EPOCHS}/{batch_id}.json"
        if not self._is_file(fs, path):
            return None
        with fs.open_input_stream(path) as source:
            return [Part(**p) for p in json.loads(source.read())]

    def decide(self, batch_id: int, parts: list[Part]) -> None:
        fs, base = filesystem(self.folder)
        fs.create_dir(f"{base}/{EPOCHS}")
        path = f"{base}/{EPOCHS}/{batch_id}.json"
        with fs.open_output_stream(f"{path}.new", compression=None) as out:
            out.write(json.dumps([asdict(p) for p in parts]).encode())
        durable(fs, f"{path}.new")
        fs.move(f"{path}.new", path)
        durable(fs, f"{base}/{EPOCHS}")

    def put_in_place(self, parts: list[Part]) -> None:
        fs, base = filesystem(self.folder)
        for p in parts:
            final = segment_path(base, p.log_id, p.segment_index)
            fs.create_dir(f"{base}/{p.log_id}")
            if fs.type_name != "local" and self._is_file(fs, final):  # elsewhere a rename may not replace; the part is still whole
                fs.delete_file(final)
            fs.move(f"{base}/{PARTS}/{p.name}", final)
            durable(fs, f"{base}/{p.log_id}")

    def clear(self) -> None:
        """Drops parts of attempts that failed: when an epoch is in place, no part is of any use."""
        from pyarrow import fs as pafs

        fs, base = filesystem(self.folder)
        for info in fs.get_file_info(pafs.FileSelector(f"{base}/{PARTS}", allow_not_found=True)):
            fs.delete_file(info.path)

    @staticmethod
    def _is_file(fs, path: str) -> bool:
        from pyarrow import fs as pafs

        return fs.get_file_info(path).type == pafs.FileType.File
