import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from sealwright.api import LogStore, Writer, format_version, inputs_from_dicts, inputs_from_json
from sealwright.errors import HmacMismatchError, SealError
from sealwright.operators.query import sample
from sealwright.operators.seal import SealConfig, record_inputs, seal
from sealwright.sources.lease import Lease, LeaseHeldError, break_lease
from sealwright.sources.segments import list_segments, write_segments

from . import vectors as v


def test_store(spark, key, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"), key, v.SESSION, SealConfig(1024))
    rows = [{"ts_wall": f"2026-05-10T12:00:0{i}.000Z", "ts_mono_delta": 1000 * i, "actor": "user:david", "event": e, "payload": p} for i, (e, p) in enumerate(v.INPUTS)]
    store.append(inputs_from_dicts(spark, "log", rows[:2]))
    assert store.actions == {"log": "Fresh"} and format_version() == 1
    store.append(inputs_from_dicts(spark, "log", rows[2:], 2))
    assert store.actions == {"log": "Resumed"}
    assert store.head().first()["head_hmac_hex"] == v.ROLLOVER[-1][3]
    report = store.report("log")
    assert report.ok and (report.compact, report.records_inspected) == ("Verified", 9)
    report.raise_on_violation()
    path = tmp_path / "store" / "log" / "audit-0000.cbor"
    data = bytearray(path.read_bytes())
    data[100] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(HmacMismatchError, match="HmacMismatch@s0r0"):
        store.report("log").raise_on_violation()


def test_one_writer_a_store(spark, key, tmp_path):
    folder = str(tmp_path / "store")
    with Lease(folder, "first") as first:
        with pytest.raises(LeaseHeldError, match="first holds"):
            LogStore(spark, folder, key, v.SESSION).append(inputs_from_dicts(spark, "log", [{"actor": "a", "event": "e"}]))
        assert break_lease(folder)["token"] == first.token
        # a writer whose lease was broken puts nothing in place
        sealed = seal(inputs_from_dicts(spark, "log", [{"actor": "a", "event": "e"}]), key, v.SESSION)
        with Lease(folder, "second") as second:
            with pytest.raises(Exception, match="passed to another writer"):
                write_segments(sealed, folder, key.key_id, first.token).collect()
            assert list_segments(folder) == []
            assert write_segments(sealed, folder, key.key_id, second.token).count() == 1
    assert not os.path.exists(f"{folder}/_sealed/lease") and break_lease(folder) is None


def test_of_many_writers_one_gets_the_lease(tmp_path):
    def attempt(i):
        try:
            Lease(str(tmp_path), str(i)).__enter__()
            return 1
        except LeaseHeldError:
            return 0

    with ThreadPoolExecutor(16) as pool:
        assert sum(pool.map(attempt, range(64))) == 1


def test_many_logs_go_on(spark, key, tmp_path):
    """Some torn, some whole, some new: states come to the tasks with the rows, not through the driver."""
    folder = str(tmp_path / "store")
    store = LogStore(spark, folder, key, v.SESSION)
    rows = lambda lo, hi: spark.range(lo, hi).crossJoin(spark.range(4).select(F.col("id").alias("i"))).select(F.concat(F.lit("log"), "id").alias("log"), F.col("i") + lo)
    inputs = lambda d: record_inputs(d, d["log"], d[d.columns[1]], F.lit("2026-05-10T12:00:00.000Z"), F.lit(0), F.lit("a"), F.lit("e"), F.lit(b"\xa0"))
    store.append(inputs(rows(0, 120)))
    for _, _, path, size in list_segments(folder)[::3]:
        with open(path, "r+b") as f:
            f.truncate(size - 7)
    store.append(inputs(rows(60, 160)))
    actions = store.recovery.groupBy("action").count().collect()
    assert {r["action"]: r["count"] for r in actions} == {"Repaired": 40, "Resumed": 80, "Fresh": 40}
    assert {r["compact"] for r in store.verify().collect()} == {"Verified"}
    assert store.records().count() == 120 * 4 - 40 + 100 * 4


def test_inputs(spark, tmp_path):
    with pytest.raises(SealError):
        inputs_from_dicts(spark, "a", [{"actor": "x"}])
    with pytest.raises(SealError):
        inputs_from_dicts(spark, "a", [{"actor": "x", "event": "e", "schema_version": 256}])
    for bad in (1.5, None):
        with pytest.raises(TypeError):
            inputs_from_dicts(spark, "a", [{"actor": "x", "event": "e", "payload": {"v": bad}}])
    rows = [{"ts_wall": "2026-05-10T12:00:00.000Z", "ts_mono_delta": 5, "actor": "a", "event": "e", "schema_version": 2, "payload": {"b": [1, -2, "x", True], "a": {"n": 18446744073709551615}}}]
    path = tmp_path / "inputs.json"
    path.write_text(json.dumps({"records": rows}))
    one = [tuple(r) for r in inputs_from_json(spark, str(path), "log").collect()]
    assert one == [tuple(r) for r in inputs_from_dicts(spark, "log", rows).collect()]


def test_writer_of_dicts(spark, key, tmp_path):
    folder = str(tmp_path / "store")
    row = lambda i: {"ts_wall": f"2026-05-10T12:00:0{i}.000Z", "ts_mono_delta": 1000 * i, "actor": "a", "event": "e", "payload": {"i": i}}
    with Writer(spark, folder, key, v.SESSION) as w:
        assert w.recovery_action() is None
        w.append(row(0))
        w.append(row(1))
        w.flush()
        assert (w.recovery_action(), w.recovery_truncated_bytes()) == ("Fresh", 0)
        w.append(row(2))
    path = f"{folder}/log/audit-0000.cbor"
    with open(path, "r+b") as f:
        f.truncate(os.path.getsize(path) - 3)
    with Writer(spark, folder, key, v.SESSION) as w:
        w.append(row(3))
    assert w.recovery_action() == "Repaired" and w.recovery_truncated_bytes() > 0
    assert [r["ts_wall"][18] for r in w.store.iterate().collect()] == ["0", "1", "3"]
    assert w.store.report("log").ok


def test_iteration_ends_at_a_gap(spark, key, make_inputs, tmp_path):
    folder = str(tmp_path / "store")
    store = LogStore(spark, folder, key, v.SESSION, SealConfig(1024))
    store.append(make_inputs([(log, i, i, "e.x", {"i": i}) for log in ("a", "b") for i in range(15)]))
    whole = store.iterate().collect()
    assert [r["file_offset"] for r in whole if r["log_id"] == "a"] == [r["file_offset"] for r in whole if r["log_id"] == "b"]
    os.remove(f"{folder}/a/audit-0001.cbor")
    os.remove(f"{folder}/b/audit-0000.cbor")
    got = store.iterate().collect()
    assert got == [r for r in whole if r["log_id"] == "a" and r["segment_index"] == 0]


def test_samples_keep_equal_records(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,), (2,)], "x int")
    assert sorted(r[0] for r in sample(rows, [F.col("x")], 2).collect()) == [1, 1, 2, 2]
    assert sorted(r[0] for r in sample(rows, [F.col("x")], 1).collect()) == [1, 2]
    assert sample(rows.limit(0), [F.col("x")], 1).collect() == []
