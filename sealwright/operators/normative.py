"""The normative violation report: per kind of violation a location, exactly its evidence, and a message.

A report row names where a log failed; a task opens that segment there and reads what the evidence needs: a header, or a
frame and the one before. So the work is a few reads a failed log, whichever way it was verified.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FORMAT_VERSION, HEADER_BODY, HEADER_BYTES
from ..functions import cbor
from ..sources.ranges import segment_files
from ..sources.segments import filesystem, frames_of
from .walk import millis

#: The evidence of each kind, by subkind where it has several, and the types of its fields.
EVIDENCE = {
    "HmacMismatch": {"expected_hmac_hex": str, "actual_hmac_hex": str, "payload_len": int, "payload_byte_offset": int},
    "ChainBreak": {"expected_prev_hash_hex": str, "actual_prev_hash_hex": str, "preceding_record_id": (int, type(None)), "is_genesis": bool},
    "RecordCorrupt/LenMismatch": {"subkind": str, "len_prefix": (int, type(None)), "len_trailer": (int, type(None))},
    "RecordCorrupt/NotCanonicalCbor": {"subkind": str, "byte_offset_in_payload": int, "rule": str},
    "RecordCorrupt/UnknownKey": {"subkind": str, "key": int},
    "RecordCorrupt/MissingKey": {"subkind": str, "key": int},
    "RecordCorrupt/WrongType": {"subkind": str, "key": int, "expected_type": str, "actual_major_type": int},
    "TimestampRegression": {"current_ts_wall": str, "preceding_ts_wall": str, "delta_ms": int, "across_sessions": bool},
    "TimestampInconsistency": {"session_id_hex": str, "current_ts_wall": str, "preceding_ts_wall": str, "current_ts_mono_delta": int, "preceding_ts_mono_delta": int, "wall_delta_ms": int, "mono_delta_ms": int, "divergence_ms": int},
    "SegmentDiscontinuity": {"expected_prev_final_hex": str, "actual_prev_final_hex": str, "preceding_segment_index": int, "preceding_segment_final_hex": str},
    "KeyIdMismatch": {"header_key_id_hex": str, "record_key_id_hex": str},
    "HeaderCorrupt/CrcMismatch": {"subkind": str, "expected_crc32": int, "actual_crc32": int, "header_bytes_hex": str},
    "HeaderCorrupt/BadMagic": {"subkind": str, "actual_magic_hex": str, "header_bytes_hex": str},
    "HeaderCorrupt/Truncated": {"subkind": str, "message": str},
    "HeaderCorrupt/ReservedBytesNonZero": {"subkind": str, "actual_hex": str},
    "UnknownVersion": {"actual_version": int, "supported_versions": list},
}
#: The rule that a codec error breaks, and the major types of the record's fields.
RULES = {"not canonical": "shortest-int-encoding", "map keys out of order": "map-key-order", "unsupported length": "definite-length", "bad UTF-8": "utf8-shortest", "unsupported tag": "unused-tag", "unsupported simple value": "float-disallowed"}
TYPES = {1: "uint", 2: "bstr", 3: "tstr", 4: "uint", 5: "bstr", 6: "tstr", 7: "tstr", 8: "map", 9: "bstr", 10: "uint"}
MESSAGE_CHARS = 200
REPORT = "log_id string, report string"


def check_evidence(kind: str, evidence: dict) -> None:
    """Raises unless the evidence has exactly its kind's fields, of their types."""
    name = f"{kind}/{evidence['subkind']}" if "subkind" in evidence else kind
    fields = EVIDENCE[name]
    if set(fields) != set(evidence) or not all(isinstance(evidence[f], t) for f, t in fields.items()):
        raise ValueError(f"evidence of {name}: {evidence}")


def _decode_evidence(payload: bytes) -> dict:
    """Evidence of a payload that isn't a record's."""
    try:
        value = cbor.decode(payload)
    except cbor.LogFormatError as e:
        rule = next((r for text, r in RULES.items() if text in str(e)), "definite-length")
        return {"subkind": "NotCanonicalCbor", "byte_offset_in_payload": getattr(e, "at", 0), "rule": rule}
    keys = set(value) if isinstance(value, dict) else set()
    unknown = sorted(k for k in keys if type(k) is int and 11 <= k <= 99)
    missing = [k for k in TYPES if k not in keys]
    if unknown:
        return {"subkind": "UnknownKey", "key": unknown[0]}
    if missing:
        return {"subkind": "MissingKey", "key": missing[0]}
    number = cbor.wrong_field(value) or 8
    return {"subkind": "WrongType", "key": number, "expected_type": TYPES[number], "actual_major_type": cbor.encode_any(value[number])[0] >> 5}


def _frame_at(source, at: int) -> tuple[bytes | None, dict | None]:
    """(payload, record) of the frame at a place."""
    source.seek(at)
    length = int.from_bytes(source.read(4), "little")
    if at + 40 + length > source.size():
        return None, None
    source.seek(at)
    _, payload, _, torn = next(frames_of(source.read(40 + length), 0))
    return (None, None) if torn else (payload, cbor.decode_record(payload)[0])


def _record_before(source, at: int) -> dict | None:
    if at < HEADER_BYTES + 40:
        return None
    source.seek(at - 4)
    start = at - 40 - int.from_bytes(source.read(4), "little")
    return _frame_at(source, start)[1] if start >= HEADER_BYTES else None


def evidence(source, before, v: dict, key_id: bytes) -> tuple[dict, str]:
    """(evidence, message) of a violation in an open segment; before is the open segment before it, if there is one."""
    kind, at, seg, record_id = v["kind"], v["byte_offset"], v["segment_index"], v["record_id"]
    place = f"s{seg}r{record_id}"
    source.seek(0)
    header = source.read(min(HEADER_BYTES, source.size()))
    if kind == "HmacMismatch":
        payload, _ = _frame_at(source, at)
        return {"expected_hmac_hex": v["expected"], "actual_hmac_hex": v["actual"], "payload_len": len(payload), "payload_byte_offset": at + 4}, f"HMAC mismatch at {place}: expected {v['expected'][:6]}..., got {v['actual'][:6]}..."
    if kind == "ChainBreak":
        earlier = _record_before(source, at)
        number = earlier[1] if earlier else None
        return {"expected_prev_hash_hex": v["expected"], "actual_prev_hash_hex": v["actual"], "preceding_record_id": number, "is_genesis": seg == 0 and at == HEADER_BYTES}, f"Chain break at {place}: prev_hash does not link to the preceding record ({'none' if number is None else number})"
    if kind == "RecordCorrupt" and v["detail"] == "TornTail":
        source.seek(at)
        raw, size = source.read(min(4, source.size() - at)), source.size()
        prefix = int.from_bytes(raw, "little") if len(raw) == 4 else None
        trailer = None
        if prefix is not None and at + 40 + prefix <= size:
            source.seek(at + 36 + prefix)
            trailer = int.from_bytes(source.read(4), "little")
        return {"subkind": "LenMismatch", "len_prefix": prefix, "len_trailer": trailer}, f"Record in segment {seg} at byte {at} has len_prefix={prefix} but len_trailer={trailer} (torn-tail or tampering)"
    if kind == "RecordCorrupt":
        found = _decode_evidence(_frame_at(source, at)[0])
        return found, f"Record at {place} is corrupt: {found['subkind']}"
    if kind in ("TimestampRegression", "TimestampInconsistency"):
        now = _frame_at(source, at)[1]
        earlier = _record_before(source, at) or (_record_before(before, before.size()) if before else None)
        wall, mono, same = millis(now[3]) - millis(earlier[3]), now[4] - earlier[4], now[5] == earlier[5]
        if kind == "TimestampRegression":
            return {"current_ts_wall": now[3], "preceding_ts_wall": earlier[3], "delta_ms": wall, "across_sessions": not same}, f"ts_wall regressed {-wall} ms at {place} {'within session' if same else 'across sessions'}"
        return {"session_id_hex": now[5].hex(), "current_ts_wall": now[3], "preceding_ts_wall": earlier[3], "current_ts_mono_delta": now[4], "preceding_ts_mono_delta": earlier[4], "wall_delta_ms": wall, "mono_delta_ms": mono, "divergence_ms": abs(wall - mono)}, f"Within session, wall advanced {wall} ms while monotonic advanced {mono} ms ({place})"
    if kind == "SegmentDiscontinuity":
        return {"expected_prev_final_hex": v["expected"], "actual_prev_final_hex": v["actual"], "preceding_segment_index": v["before_index"], "preceding_segment_final_hex": v["expected"]}, f"Segment {seg} prev_final does not match segment {v['before_index']} final"
    if kind == "KeyIdMismatch" and record_id is not None:
        return {"header_key_id_hex": header[8:40].hex(), "record_key_id_hex": v["actual"]}, f"Record {place} key_id does not match segment header key_id"
    if kind == "KeyIdMismatch":  # no record is read under a header of another key; the key's own id stands in
        return {"header_key_id_hex": header[8:40].hex(), "record_key_id_hex": key_id.hex()}, f"Segment {seg} header key_id is not the key's"
    if kind == "UnknownVersion":
        version = int.from_bytes(header[4:6], "little")
        return {"actual_version": version, "supported_versions": [FORMAT_VERSION]}, f"Segment {seg} declares version {version}; this verifier supports [{FORMAT_VERSION}]"
    import zlib

    whole = header.hex()
    if v["detail"] == "Truncated":
        return {"subkind": "Truncated", "message": f"{len(header)} of {HEADER_BYTES} bytes"}, f"Segment {seg} header ends after {len(header)} bytes"
    if v["detail"] == "BadMagic":
        return {"subkind": "BadMagic", "actual_magic_hex": header[:4].hex(), "header_bytes_hex": whole}, f"Segment {seg} does not begin with the magic bytes"
    if v["detail"] == "ReservedBytesNonZero":
        return {"subkind": "ReservedBytesNonZero", "actual_hex": header[76:80].hex()}, f"Segment {seg} header has non-zero reserved bytes"
    expected, actual = zlib.crc32(header[:HEADER_BODY]), int.from_bytes(header[72:76], "little")
    return {"subkind": "CrcMismatch", "expected_crc32": expected, "actual_crc32": actual, "header_bytes_hex": whole}, f"Segment {seg} header CRC mismatch: expected 0x{expected:08x}, got 0x{actual:08x}"


def normative_report(spark: SparkSession, folder: str, report: DataFrame, key_id: bytes) -> DataFrame:
    """log_id, report: a JSON object a log, with its first violation or null; fields in order of their names.

    ``report`` has verify()'s rows of the logs below folder. Raises where evidence isn't exactly its kind's.
    """
    files = segment_files(spark, folder).drop("file_bytes")
    first = F.get("violations", F.lit(0))
    rows = report.select("log_id", "segments_inspected", "records_inspected", "first_segment_index", "last_segment_index", "final_hmac_hex", first.alias("v"))
    mine = files.select(F.col("log_id").alias("l"), F.col("segment_index").alias("s"), "path")
    rows = rows.join(mine, (F.col("log_id") == F.col("l")) & (F.col("v.segment_index") == F.col("s")), "left").drop("l", "s")
    # the segment before the failed one: of the 10,000 at most that a log has
    before = files.join(rows.select("log_id", F.col("v.segment_index").alias("failed")), "log_id").filter("segment_index < failed").groupBy("log_id").agg(F.max_by(F.struct("segment_index", "path"), "segment_index").alias("before"))
    rows = rows.join(before, "log_id", "left")

    def build(batches):
        import contextlib

        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                v, found = r["v"], None
                if v is not None:
                    with contextlib.ExitStack() as stack:
                        opened = lambda path: stack.enter_context((f := filesystem(path))[0].open_input_file(f[1]))  # noqa: B023, E731
                        earlier = r["before"]
                        proof, message = evidence(opened(r["path"]), opened(earlier["path"]) if earlier else None, v | {"before_index": earlier and earlier["segment_index"]}, key_id)
                    check_evidence(v["kind"], proof)
                    found = {"kind": v["kind"], "location": {c: v[c] for c in ("segment_index", "record_id", "byte_offset")}, "evidence": proof, "message": message[:MESSAGE_CHARS]}
                log = {"log_dir": r["log_id"], "key_id_hex": key_id.hex(), **{c: r[c] for c in ("segments_inspected", "records_inspected", "first_segment_index", "last_segment_index", "final_hmac_hex")}}
                whole = {"format_version": FORMAT_VERSION, "verdict": "Violation" if found else "Verified", "log": log, "violation": found}
                out.append((r["log_id"], json.dumps(whole, sort_keys=True, separators=(",", ":"))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["log_id", "report"])

    return rows.mapInArrow(build, REPORT)
