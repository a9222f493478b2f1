"""The normative report of damaged files: each kind with exactly its evidence."""

import json
import os

import pytest

from sealwright.functions import cbor
from sealwright.operators.normative import EVIDENCE, check_evidence, normative_report
from sealwright.operators.seal import SealConfig, seal
from sealwright.operators.verify import VerifyOptions, report_json, verify_files
from sealwright.sources.segments import frame, frames_of, write_segments

from . import vectors as v
from .test_walk import damaged  # noqa: F401


def test_reports_of_damaged_files(spark, key, damaged):  # noqa: F811
    options = VerifyOptions(strict_time=True)
    verdicts = {r["log_id"]: r for r in verify_files(spark, damaged, key, options).collect()}
    got = {r["log_id"]: json.loads(r["report"]) for r in normative_report(spark, damaged, verify_files(spark, damaged, key, options), key.key_id).collect()}
    assert got.keys() == verdicts.keys()
    for log, report in got.items():
        r = verdicts[log]
        assert report["verdict"] == r["verdict"] and report["log"]["final_hmac_hex"] == r["final_hmac_hex"] and report["log"]["key_id_hex"] == key.key_id.hex()
        if r["verdict"] == "Verified":
            assert report["violation"] is None
        else:
            x, first = report["violation"], r["violations"][0]
            assert (x["kind"], x["location"]["segment_index"], x["location"]["record_id"], x["location"]["byte_offset"]) == (first["kind"], first["segment_index"], first["record_id"], first["byte_offset"])
            assert len(x["message"]) <= 200 and x["message"].isascii()
    assert {x["violation"]["kind"] for x in got.values() if x["violation"]} >= {"HmacMismatch", "ChainBreak", "RecordCorrupt", "TimestampRegression", "TimestampInconsistency", "SegmentDiscontinuity", "KeyIdMismatch", "HeaderCorrupt"}
    back = got["log40"]["violation"]["evidence"]
    assert back["delta_ms"] < -60_000 and not back["across_sessions"] and back["current_ts_wall"] < back["preceding_ts_wall"]
    drift = got["log41"]["violation"]["evidence"]
    assert drift["divergence_ms"] == abs(drift["wall_delta_ms"] - drift["mono_delta_ms"]) > 60_000


def rebuilt(fields):
    return b"\xaa" + b"".join(bytes([k]) + cbor.encode_any(x) for k, x in fields.items())


CASES = {
    "HeaderCorrupt/BadMagic": lambda b, f: b"X" + b[1:],
    "HeaderCorrupt/CrcMismatch": lambda b, f: b[:73] + b"\0\0" + b[75:],
    "HeaderCorrupt/Truncated": lambda b, f: b[:33],
    "HeaderCorrupt/ReservedBytesNonZero": lambda b, f: b[:79] + b"\1" + b[80:],
    "UnknownVersion": lambda b, f: b[:4] + b"\2" + b[5:],
    "RecordCorrupt/LenMismatch": lambda b, f: b[:-2] + b"\xff" + b[-1:],
    "RecordCorrupt/NotCanonicalCbor": lambda b, f: f(lambda p: p[:1] + b"\x18\1" + p[2:]),
    "RecordCorrupt/UnknownKey": lambda b, f: f(lambda p: rebuilt({k if k < 10 else 12: x for k, x in cbor.decode(p).items()})),
    "RecordCorrupt/MissingKey": lambda b, f: f(lambda p: b"\xa9" + rebuilt({k: x for k, x in cbor.decode(p).items() if k != 10})[1:]),
    "RecordCorrupt/WrongType": lambda b, f: f(lambda p: rebuilt({k: x if k != 6 else b"no text" for k, x in cbor.decode(p).items()})),
}


@pytest.mark.parametrize("name", CASES)
def test_each_subkind(spark, key, make_inputs, tmp_path, name):
    folder = str(tmp_path / "store")
    os.makedirs(folder)
    write_segments(seal(make_inputs([("log", i, i, "e.x", {"i": i}) for i in range(4)]), key, v.SESSION, SealConfig(4096)), folder, key.key_id).collect()
    path = f"{folder}/log/audit-0000.cbor"
    data = open(path, "rb").read()
    frames = [(p, h) for _, p, h, _ in frames_of(data)]

    def second(change):
        changed = change(frames[1][0])
        return data[:80] + b"".join(frame(*f) for f in (frames[0], (changed, key.sign(changed)), *frames[2:]))

    open(path, "wb").write(CASES[name](data, second))
    report = verify_files(spark, folder, key)
    found = json.loads(normative_report(spark, folder, report, key.key_id).first()["report"])["violation"]
    assert name == "/".join([found["kind"], *([found["evidence"]["subkind"]] if "subkind" in found["evidence"] else [])])
    if name.endswith("NotCanonicalCbor"):
        assert found["evidence"] == {"subkind": "NotCanonicalCbor", "byte_offset_in_payload": 1, "rule": "shortest-int-encoding"}
    if name.endswith("WrongType"):
        assert found["evidence"] == {"subkind": "WrongType", "key": 6, "expected_type": "tstr", "actual_major_type": 2}
    line = json.loads(report_json(report, key.key_id).first()["json"])
    assert line["status"] == "tampered" and line["violation"]["kind"] == found["kind"] and line["log"]["key_id_hex"] == key.key_id.hex()


def test_evidence_is_checked():
    check_evidence("UnknownVersion", {"actual_version": 2, "supported_versions": [1]})
    assert len(EVIDENCE) == 16
    for bad in ({"actual_version": 2}, {"actual_version": "2", "supported_versions": [1]}, {"actual_version": 2, "supported_versions": [1], "more": 1}):
        with pytest.raises(ValueError):
            check_evidence("UnknownVersion", bad)
