import os
import random

import pytest
from pyspark.sql import functions as F

from sealwright.errors import HmacMismatchError, LogFormatError, RecoveryError
from sealwright.functions.expressions import hex_lower
from sealwright.keys import LocalKey
from sealwright.operators import query as q
from sealwright.operators.recover import peek_record_id, plan, recover
from sealwright.operators.seal import SealConfig, seal, seal_native
from sealwright.operators.verify import VerifyOptions, decoded, one_segment, raise_on_violation, report_json, verify, violations
from sealwright.sources.segments import frame, frames_of, header, list_segments, read_log, write_segments
from sealwright.streaming.tail import seal_stream, tail

from . import vectors as v

SMALL = SealConfig(segment_bytes=1024)


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path / "store")


@pytest.fixture()
def written(spark, key, vector_inputs, folder):
    os.makedirs(folder)
    write_segments(seal(vector_inputs, key, v.SESSION, SMALL), folder, key.key_id).collect()
    return folder


def compact(spark, folder, key, options=VerifyOptions()):
    return [r["compact"] for r in verify(*read_log(spark, folder), key, options).collect()]


def path(folder, segment=0, log="log"):
    return f"{folder}/{log}/audit-{segment:04d}.cbor"


def patch(folder, segment, offset, xor=0xFF):
    data = bytearray(open(path(folder, segment), "rb").read())
    data[offset] ^= xor
    open(path(folder, segment), "wb").write(data)


def test_sealed_bytes_are_the_published_ones(spark, key, vector_inputs):
    rows = sorted((r["segment_index"], r["record_id"], len(r["payload_bytes"]), r["hmac"].hex()) for r in seal(vector_inputs, key, v.SESSION, SMALL).collect())
    assert rows == v.ROLLOVER
    heads = seal_native(vector_inputs.filter("seq < 3"), v.SECRET, key.key_id, v.SESSION).select("records", hex_lower(F.col("head"))).collect()
    assert [tuple(r) for r in heads] == [(3, v.ROLLOVER[2][3])]


def test_files(spark, key, written):
    assert [os.path.getsize(path(written, i)) for i in range(3)] == v.FILE_BYTES
    report = verify(*read_log(spark, written), key).collect()[0]
    assert (report["compact"], report["segments_inspected"], report["records_inspected"], report["final_hmac_hex"]) == ("Verified", 3, 9, v.ROLLOVER[-1][3])
    assert report["summary"] == f"✓ Verified · 9 events · chain head {v.ROLLOVER[-1][3][:8]}"
    records = decoded(read_log(spark, written)[0])
    head = q.head(records).collect()[0]
    assert (head["record_count"], head["segments"], head["last_event"]) == (9, 3, "vault.locked")
    start = {r["segment_index"]: r["chain_start_hex"] for r in q.segment_summary(records).collect()}
    assert start == {0: v.CHAIN_START, 1: v.ROLLOVER[3][3], 2: v.ROLLOVER[7][3]}
    assert q.seek(records, 1, 2).count() == 1 and q.show(records, 1, 3, "david", "shield.*").count() == 4
    assert read_log(spark, written, 1, 1)[0].count() == 4
    with pytest.raises(LogFormatError):
        read_log(spark, written + "-missing")


CASES = [
    (lambda f: patch(f, 0, 80 + 207 + 222 + 4 + 50), "HmacMismatch@s0r2"),
    (lambda f: patch(f, 0, 0), "HeaderCorrupt@s0"),
    (lambda f: patch(f, 0, 4), "UnknownVersion@s0"),
    (lambda f: patch(f, 1, 73), "HeaderCorrupt@s1"),
    (lambda f: patch(f, 1, 77), "HeaderCorrupt@s1"),
    (lambda f: patch(f, 2, 286), "RecordCorrupt@s2"),
    (lambda f: open(path(f, 2), "wb").write(b"short"), "HeaderCorrupt@s2"),
    (lambda f: os.remove(path(f, 1)), "SegmentDiscontinuity@s2"),
    (lambda f: os.remove(path(f, 0)), "Verified"),
]


@pytest.mark.parametrize(("change", "verdict"), CASES)
def test_tampering(spark, key, written, change, verdict):
    change(written)
    assert compact(spark, written, key) == [verdict]


def test_missing_record_and_other_key(spark, key, written):
    data = open(path(written), "rb").read()
    frames = list(frames_of(data))
    open(path(written), "wb").write(data[:80] + b"".join(frame(p, h) for i, (_, p, h, _) in enumerate(frames) if i != 2))
    assert compact(spark, written, key) == ["ChainBreak@s0r3"]
    assert compact(spark, written, LocalKey(bytes(32))) == ["KeyIdMismatch@s0"]
    report = verify(*read_log(spark, written), LocalKey(v.SECRET, bytes(32)))
    assert violations(report).count() == 1


def test_every_byte_counts(spark, key, make_inputs, folder):
    """Each byte of a three-record log, flipped or zeroed, as a log of its own; all are verified in one job."""
    os.makedirs(folder)
    write_segments(seal(make_inputs([("log", i, i, "q.tick", {"i": i}) for i in range(3)]), key, v.SESSION), folder, key.key_id).collect()
    data = open(path(folder), "rb").read()
    frames, segments = [], []
    for offset in range(len(data)):
        for name, byte in (("flip", data[offset] ^ 0xFF), ("zero", 0)):
            if byte != data[offset]:
                changed = data[:offset] + bytes([byte]) + data[offset + 1 :]
                segments.append((f"{name}{offset}", 0, changed[:80], len(changed)))
                frames += [(f"{name}{offset}", 0, *f) for f in frames_of(changed)]
    from sealwright.sources.segments import FRAMES, SEGMENTS

    report = verify(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(segments, SEGMENTS), key).collect()
    assert len(report) == len(segments) > 700
    assert [r["log_id"] for r in report if r["verdict"] == "Verified"] == []


def test_forensic_walk(spark, key, written):
    patch(written, 0, 80 + 4 + 20)
    patch(written, 2, 80 + 4 + 20)
    frames, segments = read_log(spark, written)
    all_of = verify(frames, segments, key, VerifyOptions(forensic=True)).collect()[0]
    assert [(x["kind"], x["segment_index"]) for x in all_of["violations"]] == [("HmacMismatch", 0), ("HmacMismatch", 2)]
    assert [r["kind"] for r in one_segment(frames, segments, key, 2).collect()] == ["HmacMismatch"]
    assert one_segment(frames, segments, key, 1).count() == 0
    json = report_json(verify(frames, segments, key, VerifyOptions(forensic=True)), key.key_id).collect()[0]["json"]
    assert '"status":"tampered"' in json and '"additional_violations":[{' in json
    with pytest.raises(HmacMismatchError, match="HmacMismatch@s0r0"):
        raise_on_violation(verify(frames, segments, key))


def test_cascade_after_a_bad_segment(spark, key, make_inputs, folder):
    os.makedirs(folder)
    rows = [("log", i, i, "q.tick", {"i": i}) for i in range(20)]
    write_segments(seal(make_inputs(rows), key, v.SESSION, SMALL), folder, key.key_id).collect()
    patch(folder, 1, 100)
    kinds = lambda o: [(x["kind"], x["segment_index"]) for x in verify(*read_log(spark, folder), key, o).collect()[0]["violations"]]
    assert kinds(VerifyOptions(forensic=True))[:2] == [("HmacMismatch", 1), ("SegmentDiscontinuity", 2)]
    assert kinds(VerifyOptions(forensic=True, cascade=False)) == [("HmacMismatch", 1)]


def test_time_goes_back_across_segments(spark, key, make_inputs, folder):
    os.makedirs(folder)
    rows = [("log", i, 600 + i if i < 4 else i, "q.tick", {"i": i}) for i in range(9)]
    write_segments(seal(make_inputs(rows), key, v.SESSION, SealConfig(segment_bytes=900)), folder, key.key_id).collect()
    assert compact(spark, folder, key) == ["TimestampRegression@s2r0"]


def test_logs_do_not_influence_each_other(spark, key, make_inputs, folder):
    os.makedirs(folder)
    rows = [(log, i, i, "e.v", {"n": i}) for log in ("a", "b", "c") for i in range(5)]
    write_segments(seal(make_inputs(rows), key, v.SESSION), folder, key.key_id).collect()
    data = bytearray(open(path(folder, 0, "b"), "rb").read())
    data[100] ^= 1
    open(path(folder, 0, "b"), "wb").write(data)
    assert {r["log_id"]: r["compact"] for r in verify(*read_log(spark, folder), key).collect()} == {"a": "Verified", "b": "HmacMismatch@s0r0", "c": "Verified"}


@pytest.mark.parametrize("bad", [[("log", 1, 0, "e", {}), ("log", 1, 1, "e", {})], [("log", 1, 0, None, {})]])
def test_bad_inputs_are_refused(make_inputs, key, bad):
    with pytest.raises(Exception, match="two records|not a record input"):
        seal(make_inputs(bad), key, v.SESSION).collect()


def test_crash_recovery(spark, key, make_inputs, folder):
    """Random truncations: recover, verify, go on, verify again."""
    os.makedirs(folder)
    rng, rows = random.Random(8), [(f"log{k}", i, i, "stress.tick", {"i": i, "tag": f"rec-{i:04}"}) for k in range(12) for i in range(12)]
    write_segments(seal(make_inputs(rows), key, v.SESSION, SMALL), folder, key.key_id).collect()
    for k in range(12):
        log = f"log{k}"
        last = max(seg for name, seg, _, _ in list_segments(folder) if name == log)
        data = open(path(folder, last, log), "rb").read()
        cut = rng.randrange(0, len(data) - 80)
        open(path(folder, last, log), "wb").write(data[: len(data) - cut])
    states = recover(spark, folder, key)
    actions = {r["action"]: r for r in states.collect()}
    assert actions.keys() <= {"Resumed", "Repaired", "OpenedNextAfterFinalized"} and actions["Repaired"]["truncated_bytes"] > 0
    assert set(compact(spark, folder, key)) == {"Verified"}
    more = make_inputs([(f"log{k}", 100 + i, 100 + i, "stress.more", {"i": i}) for k in range(12) for i in range(6)])
    write_segments(seal(more, key, v.SESSION, SMALL, states), folder, key.key_id).collect()
    assert set(compact(spark, folder, key)) == {"Verified"}
    records = decoded(read_log(spark, folder)[0])
    assert records.filter("event = 'stress.more'").groupBy("log_id").count().filter("count = 6").count() == 12


def test_recovery_refuses_tampering(spark, key, written):
    patch(written, 2, 100)
    before = open(path(written, 2), "rb").read()
    with pytest.raises(RecoveryError, match="1 logs can't be extended: log: HmacMismatch at record 0, byte 80"):
        recover(spark, written, key)
    assert open(path(written, 2), "rb").read() == before
    r = plan(spark, written, LocalKey(bytes(32))).first()
    assert (r["action"], r["refused"], r["refused_record_id"]) == ("Refused", "KeyIdMismatch", None)


def test_ids_are_peeked_at():
    assert peek_record_id(b"\xa1\x01\x18\x2a") == 42
    for other in (None, b"", b"\xa1\x01\x61x", b"\xa1\x02\x01", b"\x01", b"\xa1\x01\x20", b"\xff"):
        assert peek_record_id(other) is None


def test_a_torn_end_behind_a_closing_record_is_cut(spark, key, written):
    open(path(written, 1), "ab").write(b"torn")
    os.remove(path(written, 2))
    r = recover(spark, written, key).first()
    assert (r["action"], r["truncated_bytes"], r["segment"], r["records_in_segment"], int(r["last_record_id"])) == ("OpenedNextAfterFinalized", 4, 2, 4, 3)
    assert os.path.getsize(path(written, 1)) == v.FILE_BYTES[1]


def test_an_idle_trigger_opens_no_file(spark, key, written, monkeypatch):
    from sealwright.sources import segments

    stream = segments.SegmentStream({"path": written})
    assert stream.initialOffset() == {}
    first = stream.latestOffset()
    assert first == {"log": f"2:{v.FILE_BYTES[2]}"}  # earlier segments are retired
    walked = []
    plain = segments.SegmentStream._whole
    monkeypatch.setattr(segments.SegmentStream, "_whole", lambda self, *a: walked.append(a) or plain(self, *a))
    assert stream.latestOffset() == first and walked == []
    data = open(path(written, 2), "rb").read()
    open(path(written, 2), "ab").write(data[80:])
    grown = stream.latestOffset()
    assert grown == {"log": f"2:{2 * v.FILE_BYTES[2] - 80}"} and [a[2] for a in walked] == [v.FILE_BYTES[2]]
    again = segments.SegmentStream({"path": written})  # a restart begins with the batch that wasn't finished
    rows = [r for p in again.partitions(first, grown) for r in again.read(p)]
    assert [r[2] for r in rows] == [v.FILE_BYTES[2] + (f[0] - 80) for f in frames_of(data)]
    assert again.partitions(grown, grown) == []


def test_a_tail_of_many_logs_takes_few_tasks(tmp_path, monkeypatch):
    """The driver opens a log's last segment only, and a task reads segments of many logs."""
    from sealwright.sources import segments

    for log in range(100):
        for seg in (0, 1, 2, 5) if log % 2 else (0, 1, 2):
            os.makedirs(tmp_path / f"l{log}" / "deep", exist_ok=True)
            (tmp_path / f"l{log}" / "deep" / f"audit-{seg:04d}.cbor").write_bytes(header(seg, bytes(32), bytes(32)) + b"".join(frame(b"%d %d %d" % (log, seg, i), bytes(32)) for i in range(log % 5)))
    (tmp_path / "l3" / "deep" / "audit-0001.cbor").open("ab").write(b"torn")
    (tmp_path / "l3" / "deep" / "old-audit-0001.cbor").write_bytes(bytes(100))
    walked = []
    plain = segments.SegmentStream._whole
    monkeypatch.setattr(segments.SegmentStream, "_whole", lambda self, *a: walked.append(a) or plain(self, *a))
    stream = segments.SegmentStream({"path": str(tmp_path)})
    end = stream.latestOffset()
    assert len(walked) == 100 and len(end) == 100
    tasks = stream.partitions({}, end)
    assert len(tasks) == 1 and len(segments.SegmentReader({"path": str(tmp_path)}).partitions()) == 1
    want = sorted((log, seg, *f) for log, seg, file, _ in list_segments(str(tmp_path)) for f in frames_of(open(file, "rb").read()))
    assert len(want) == 701 and sorted(r for p in tasks for r in stream.read(p)) == want
    monkeypatch.setattr(segments, "TASK_BYTES", 10 * segments.OPEN_BYTES)
    monkeypatch.setattr(segments, "RUN_BYTES", 2 * segments.OPEN_BYTES)
    tasks = stream.partitions({}, end)
    assert 25 <= len(tasks) <= 70 and sorted(r for p in tasks for r in stream.read(p)) == want
    monkeypatch.setattr(segments, "MOST_TASKS", 5)
    assert len(stream.partitions({}, end)) <= 6
    (tmp_path / "l4" / "deep" / "audit-0002.cbor").open("ab").write(frame(b"more", bytes(32)))
    grown = stream.latestOffset()
    assert [r[3] for p in stream.partitions(end, grown) for r in stream.read(p)] == [b"more"] and len(walked) == 101


def test_a_backlog_is_worked_off_in_steps(spark, key, written):
    from sealwright.sources import segments

    stream = segments.SegmentStream({"path": written, "max_bytes_per_trigger": "200"})
    at, steps, offsets = stream.initialOffset(), 0, []
    while (following := stream.latestOffset()) != at:
        offsets += [(p.segment, r[2]) for p in stream.partitions(at, following) for r in stream.read(p)]
        at, steps = following, steps + 1
    assert steps > 3
    assert offsets == sorted((r["segment_index"], r["file_offset"]) for r in read_log(spark, written)[0].collect())


def test_rows_out_of_order_are_refused(spark, key, vector_inputs, folder):
    os.makedirs(folder)
    sealed = seal(vector_inputs, key, v.SESSION).orderBy(F.col("record_id").desc()).coalesce(1)
    with pytest.raises(Exception, match="in order|shorter|No such file"):
        write_segments(sealed, folder, key.key_id).collect()


def test_live_tail(spark, key, written, tmp_path):
    data = open(path(written, 2), "rb").read()
    open(path(written, 2), "wb").write(data[:-5])  # the last frame isn't whole yet
    run = lambda: tail(spark, written).select("segment_index", "file_offset", "torn").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
    open(path(written, 2), "wb").write(data)
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 9 and out.filter("torn").count() == 0


def test_stream_sealing_equals_batch_sealing(spark, key, vector_inputs, tmp_path):
    for name, part in (("1", "seq < 3"), ("2", "seq >= 3")):
        vector_inputs.filter(part).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = spark.readStream.schema(vector_inputs.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q_ = seal_stream(stream, key, v.SESSION, SMALL).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q_.awaitTermination(180)
    rows = sorted((r["segment_index"], r["record_id"], len(r["payload_bytes"]), r["hmac"].hex()) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == v.ROLLOVER


def test_header_helper(spark, key):
    assert len(header(0, key.key_id, bytes(32))) == 80
