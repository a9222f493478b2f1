"""The walk over a range of a segment, in the task that reads it: what verify() asks of its records, as one row."""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

from ..constants import FORMAT_VERSION, HEADER_BODY, HEADER_BYTES, MAGIC
from ..functions import cbor
from ..sources.ranges import frames_between
from ..sources.segments import filesystem, frames_of

TIME = "struct<ts_ms:long,mono:decimal(20,0),session_id:binary>"
FAIL = "struct<pos:long,rank:int,file_offset:long,record_id:long,recomputed:string,stored:string,prev_stored:string,prev_hash:string,key_id:string,ts_wall:string,decode_error:string>"
STATES = f"log_id string, segment_index int, path string, file_bytes long, start long, stop long, frames long, header_rank int, prev_final binary, chain_start binary, fail {FAIL}, seen long, last_hmac binary, accepted_hmac binary, first_time {TIME}, last_time {TIME}"
_NUMBER = re.compile(r"\+?[0-9]+\n?").fullmatch


def millis(ts_wall: str) -> int:
    """functions.expressions.ts_millis of one time."""
    if len(ts_wall.encode()) != 24:
        return 0

    def part(at, n):
        return int(t) if _NUMBER(t := ts_wall[at : at + n]) else 0

    year, month = part(0, 4), part(5, 2)
    year -= month <= 2
    era, doy = year // 400, (153 * (month - 3 if month > 2 else month + 9) + 2) // 5 + part(8, 2) - 1
    yoe = year - era * 400
    days = era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468
    return ((days * 24 + part(11, 2)) * 60 + part(14, 2)) * 60_000 + part(17, 2) * 1000 + part(20, 3)


def header_rank(header: bytes, key) -> int | None:
    """The first check that a header fails, as verify.header_checks() numbers them."""
    checks = (
        len(header) >= HEADER_BYTES,
        header[:4] == MAGIC,
        header[4:6] == FORMAT_VERSION.to_bytes(2, "little"),
        header[72:76] == zlib.crc32(header[:HEADER_BODY]).to_bytes(4, "little"),
        header[8:40] == key.key_id,
        header[76:80] == bytes(4),
    )
    return next((i for i, fine in enumerate(checks) if not fine), None)


def _timed(record: dict) -> dict:
    return {"ts_ms": millis(record[3]), "mono": record[4], "session_id": record[5]}


def check_range(source, start: int, end: int, segment_index: int, key, options) -> dict:
    """The fields of STATES behind ``start``, the last record that passed, and a failed one's payload.

    A range that doesn't begin a segment looks at the frame before it. Without options times aren't checked.
    """
    from .verify import time_rank

    size = source.size()
    source.seek(0)
    header = source.read(min(HEADER_BYTES, size))
    bad = header_rank(header, key)
    prev_final = header[40:72]
    chain_start = None if bad == 0 else key.sign(header[:HEADER_BODY]) if segment_index == 0 else prev_final
    out = {"stop": start, "frames": 0, "header_rank": bad, "prev_final": prev_final, "chain_start": chain_start, "fail": None, "seen": 0, "last_hmac": None, "accepted_hmac": None, "first_time": None, "last_time": None, "last_record": None}
    if bad is not None:
        return out | {"stop": size}
    prev, before = chain_start, None
    if start > HEADER_BYTES:
        source.seek(start - 4)
        at = start - 40 - int.from_bytes(source.read(4), "little")
        if at >= HEADER_BYTES:
            source.seek(at)
            _, payload, prev, torn = next(frames_of(source.read(start - at), 0))
            record = None if torn else cbor.decode_record(payload)[0]
            before = _timed(record) if record else None
    for offset, payload, signed, torn in frames_between(source, start, end):
        record = rank = error = expected = None
        if torn:
            rank = 7
        else:
            expected = key.sign(payload)
            record, error = cbor.decode_record(payload)
            if signed != expected:
                rank = 8
            elif error:
                rank = 10 if error.startswith("schema") else 9
            elif record[2] != prev:
                rank = 11
            elif record[9] != key.key_id:
                rank = 12
        now = _timed(record) if record else None
        rank = rank or (options and time_rank(before, now, options))
        if out["frames"] == 0 and not torn:
            out["first_time"] = now
        if rank:
            hexed = lambda x: None if x is None else x.hex()
            field = lambda k: record[k] if record else None
            record_id = field(1) if record and record[1] < 1 << 63 else None
            out["fail"] = {"pos": out["frames"], "rank": rank, "file_offset": offset, "record_id": record_id, "recomputed": hexed(expected), "stored": hexed(signed), "prev_stored": hexed(prev), "prev_hash": hexed(field(2)), "key_id": hexed(field(9)), "ts_wall": field(3), "decode_error": error, "payload": payload}
            out["seen"] += not torn
            break  # a segment's verdict is its first failure
        out |= {"frames": out["frames"] + 1, "seen": out["seen"] + 1, "stop": offset + len(payload) + 40, "last_hmac": signed, "accepted_hmac": signed, "last_time": now, "last_record": record}
        prev, before = signed, now
    return out


def check_ranges(key, options):
    """check_range() of rows with log_id, segment_index, path, file_bytes, start and end, as a mapInArrow function."""

    def run(batches):
        import pyarrow as pa

        schema = _schema(pa)
        for batch in batches:
            for r in batch.to_pylist():
                fs, at = filesystem(r["path"])
                with fs.open_input_file(at) as source:
                    state = check_range(source, r["start"], r["end"], r["segment_index"], key, options)
                yield pa.RecordBatch.from_pylist([_row(r | state)], schema=schema)

    return run


def _row(state: dict) -> dict:
    from decimal import Decimal

    return state | {c: state[c] and state[c] | {"mono": Decimal(state[c]["mono"])} for c in ("first_time", "last_time")}


def _schema(pa):
    number, text, data = pa.int64(), pa.string(), pa.binary()
    time = pa.struct([("ts_ms", number), ("mono", pa.decimal128(20, 0)), ("session_id", data)])
    fail = pa.struct([("pos", number), ("rank", pa.int32()), ("file_offset", number), ("record_id", number), *((c, text) for c in ("recomputed", "stored", "prev_stored", "prev_hash", "key_id", "ts_wall", "decode_error"))])
    return pa.schema([("log_id", text), ("segment_index", pa.int32()), ("path", text), ("file_bytes", number), ("start", number), ("stop", number), ("frames", number), ("header_rank", pa.int32()), ("prev_final", data), ("chain_start", data), ("fail", fail), ("seen", number), ("last_hmac", data), ("accepted_hmac", data), ("first_time", time), ("last_time", time)])


def joined(key, options):
    """Makes a row a segment of a log's STATES rows in order."""

    def rest(part: dict, start: int) -> dict:
        fs, at = filesystem(part["path"])
        with fs.open_input_file(at) as source:
            return part | {"start": start} | check_range(source, start, part["file_bytes"], part["segment_index"], key, options)

    def one(parts: list[dict]) -> dict:
        out, at, i = None, HEADER_BYTES, 0
        while True:
            if i < len(parts) and (parts[i]["start"] == at or parts[i]["header_rank"] is not None):
                part = parts[i]
            elif at < parts[0]["file_bytes"] and (out is None or out["fail"] is None):
                part, i = rest(parts[0], at), len(parts)
            else:
                return out
            at, i = part["stop"], i + 1
            if out is None:
                out = dict(part)
                if out["header_rank"] is not None:
                    return out
            elif out["fail"] is None:
                fail = part["fail"] and part["fail"] | {"pos": part["fail"]["pos"] + out["frames"]}
                out |= {"fail": fail, "seen": out["seen"] + part["seen"], "frames": out["frames"] + part["frames"]}
                for c in ("last_hmac", "accepted_hmac", "last_time"):
                    out[c] = part[c] or out[c]
            if out["fail"] is not None:
                return out

    def run(rows: list[dict]) -> Iterator[dict]:
        for _, parts in itertools.groupby(rows, lambda r: r["segment_index"]):
            yield one(list(parts))

    return run
