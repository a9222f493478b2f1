"""Verification in one pass over files, by ranges: the same reports as the checks over all frames as columns."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from sealwright.functions.expressions import ts_millis
from sealwright.keys import LocalKey
from sealwright.operators.seal import SealConfig, seal
from sealwright.operators.verify import VerifyOptions, verify, verify_files
from sealwright.operators.walk import millis
from sealwright.sources import ranges as r
from sealwright.sources.segments import frame, frames_of, list_segments, read_log, write_segments

from . import vectors as v

SMALL = SealConfig(segment_bytes=2048)


def frames(data):
    return [(p, h) for _, p, h, torn in frames_of(data) if not torn]


def rebuilt(data, change):
    return data[:80] + b"".join(frame(*f) for f in change(frames(data)))


def signed(key, change):
    """Changes payloads and signs them, but doesn't mend the chain behind."""
    return lambda fs: [(c := change(i, p), h if c == p else key.sign(c)) for i, (p, h) in enumerate(fs)]


@pytest.fixture(scope="module")
def damaged(spark, key, tmp_path_factory):
    """Sixty logs of several segments, most of them damaged each in its own way, with and without an index."""
    from .test_ranges import record_inputs

    folder = str(tmp_path_factory.mktemp("walk") / "store")
    os.makedirs(folder)
    d = spark.range(60 * 25).select(F.format_string("log%02d", F.col("id") % 60).alias("log"), F.floor(F.col("id") / 60).alias("i"))
    second = F.when((F.col("log") == "log40") & (F.col("i") > 12), F.col("i") - 200).when((F.col("log") == "log41") & (F.col("i") > 9), F.col("i") + 5000).when(F.col("log") == "log42", F.col("i") * 500).otherwise(F.col("i"))
    ts = F.date_format(F.timestamp_millis(1_700_000_000_000 + second * 1000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    write_segments(seal(record_inputs(d, F.col("log"), F.col("i"), ts, F.col("i") * 1000, F.lit("a"), F.lit("e.x"), F.lit(b"\xa1\x61k\x01")), key, v.SESSION, SMALL), folder, key.key_id).collect()
    r.build_index(spark, folder, 500)
    rng = random.Random(9)
    cut_id = lambda i, p: p.replace(key.key_id, bytes(32)) if i == 2 else p
    schema = lambda i, p: p[:-2] + b"\x0b\x01" if i == 1 else p
    other = [
        lambda b: rebuilt(b, lambda fs: fs[:2] + fs[3:]),
        lambda b: rebuilt(b, lambda fs: fs[1:]),
        lambda b: rebuilt(b, lambda fs: [fs[1], fs[0], *fs[2:]]),
        lambda b: rebuilt(b, signed(key, cut_id)),
        lambda b: rebuilt(b, signed(key, schema)),
        lambda b: rebuilt(b, signed(key, lambda i, p: b"\xff" + p[1:] if i == 3 else p)),
        lambda b: b[:80],
        lambda b: b[:20],
        lambda b: b + b"x",
        lambda b: b[:-1],
        lambda b: b[:77] + b"\1" + b[78:],
    ]
    for n in range(40):
        path = rng.choice([p for log, _, p, _ in list_segments(folder) if log == f"log{n:02d}"])
        data = open(path, "rb").read()
        if n < 2 * len(other):
            data = other[n // 2](data)
        else:
            at = rng.randrange(len(data))
            data = data[:at] + bytes([data[at] ^ 1 << rng.randrange(8)]) + data[at + 1 :]
        open(path, "wb").write(data)
    for log in ("log43", "log44"):
        os.remove(f"{folder}/{log}/audit-000{int(log[-1]) - 3}.cbor")
    return folder


OPTIONS = [VerifyOptions(), VerifyOptions(forensic=True), VerifyOptions(forensic=True, cascade=False, strict_time=True)]


@pytest.mark.parametrize("options", OPTIONS)
def test_reports_are_those_of_the_columns(spark, key, damaged, options):
    want = sorted(verify(*read_log(spark, damaged), key, options).collect())
    assert len(want) == 60 and len({x["compact"] for x in want}) > 15
    for range_bytes in (400, 1 << 20):
        assert sorted(verify_files(spark, damaged, key, options, range_bytes).collect()) == want
    if options.strict_time:
        kinds = {x["log_id"]: x["compact"] for x in want}
        assert kinds["log41"].startswith("TimestampInconsistency") and kinds["log40"].startswith("TimestampRegression")


def test_without_an_index(spark, key, damaged, tmp_path):
    bare = str(tmp_path / "bare")
    shutil.copytree(damaged, bare, ignore=shutil.ignore_patterns("_index"))
    assert sorted(verify_files(spark, bare, key).collect()) == sorted(verify(*read_log(spark, damaged), key).collect())
    assert {x["compact"] for x in verify_files(spark, bare, LocalKey(bytes(32))).collect()} <= {"KeyIdMismatch@s0", "KeyIdMismatch@s1", "HeaderCorrupt@s0"}


def test_a_wrong_index_changes_no_verdict(spark, key, damaged, tmp_path):
    wrong = str(tmp_path / "wrong")
    shutil.copytree(damaged, wrong)
    shutil.rmtree(f"{wrong}/_index")
    index = r.read_index(spark, damaged).withColumn("path", F.regexp_replace("path", "^.*/store/", f"{wrong}/"))
    moved = (F.hash("path", "start") % 3 == 0).cast("long") * 7
    index.withColumn("end", F.col("end") + moved).withColumn("start", F.when(F.col("start") > 80, F.col("start") + moved).otherwise(F.col("start"))).filter("hash(path, end) % 5 <> 0").write.parquet(f"{wrong}/_index")
    for options in OPTIONS[:2]:
        assert sorted(verify_files(spark, wrong, key, options, 400).collect()) == sorted(verify(*read_log(spark, damaged), key, options).collect())


def test_no_record_is_shuffled(spark, key, damaged):
    plan = verify_files(spark, damaged, key)._jdf.queryExecution().executedPlan().toString()
    assert "payload_bytes" not in plan and plan.count("MapInArrow") == 2


def test_drift_over_a_segments_border_is_found(spark, key, make_inputs, tmp_path):
    """A clock that runs away just where a segment ends: V14 compares a segment's first record with the last before."""
    folder = str(tmp_path / "store")
    os.makedirs(folder)
    rows = lambda late: make_inputs([("log", i, i + (600 if i >= late else 0), "q.tick", {"i": i}) for i in range(9)]).withColumn("ts_mono_delta", F.col("seq") * 1000)
    config = SealConfig(segment_bytes=1344)
    border = seal(rows(99), key, v.SESSION, config).filter("segment_index = 0").count() - 1  # the closing record is no input
    write_segments(seal(rows(border), key, v.SESSION, config), folder, key.key_id).collect()
    strict = VerifyOptions(strict_time=True)
    one, two = verify(*read_log(spark, folder), key, strict).first(), verify_files(spark, folder, key, strict).first()
    assert one == two and one["compact"] == "TimestampInconsistency@s1r0"
    assert verify_files(spark, folder, key).first()["compact"] == "Verified"


def test_times(spark):
    rng = random.Random(2)
    times = ["2026-05-10T12:00:00.123Z", "0000-01-01T00:00:00.000Z", "2024-02-29T23:59:59.999Z", "2023-02-30T00:00:00.000Z", "9999-12-31T23:59:59.999Z", "short", "", "x" * 24, "2026-13-99T99:99:99.9x9Z", "+026-05-10T12:00:00.123Z"]
    for _ in range(300):
        t = list("2026-05-10T12:00:00.123Z")
        t[rng.randrange(24)] = rng.choice("0123456789+- xZ")
        times.append("".join(t))
    got = spark.createDataFrame([(t,) for t in times], "t string").select("t", ts_millis(F.col("t")).alias("ms")).collect()
    assert [(x["t"], x["ms"]) for x in got] == [(t, millis(t)) for t in times]
