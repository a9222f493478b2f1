"""Records parsed in the JVM are what the codec decodes."""

import random

from pyspark.sql import functions as F

from sealwright.functions import cbor
from sealwright.functions.records import FIELDS, parsed
from sealwright.plans import queries as p


def payload(rng, depth=0):
    kinds = [lambda: rng.randrange(1 << rng.randrange(1, 64)), lambda: -1 - rng.randrange(1 << rng.randrange(1, 40)), lambda: rng.randbytes(rng.randrange(40)), lambda: "é日" * rng.randrange(20), lambda: rng.random() < 0.5]
    if depth < 3:
        kinds += [lambda: [payload(rng, depth + 1) for _ in range(rng.randrange(4))], lambda: {f"k{i}": payload(rng, depth + 1) for i in range(rng.randrange(30))}]
    return rng.choice(kinds)()


def record(rng):
    text = lambda: "".join(rng.choice("aé日x 𝄞") for _ in range(rng.choice([0, 3, 23, 24, 90, 300])))
    number = lambda: rng.randrange(1 << rng.choice([1, 5, 8, 16, 32, 63, 64]))
    fields = {1: number(), 2: rng.randbytes(32), 3: rng.choice(["2026-05-10T12:00:00.000Z", text()]), 4: number(), 5: rng.randbytes(16), 6: text(), 7: text(), 8: {f"k{i}": payload(rng) for i in range(rng.randrange(5))}, 9: rng.randbytes(32), 10: rng.randrange(256)}
    return b"\xaa" + b"".join(bytes([k]) + cbor.encode(x) for k, x in fields.items())


def compare(spark, records):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, payload_bytes binary").repartition(4)
    got = {r["i"]: r for r in parsed(df).collect()}
    assert len(got) == len(records)
    bad = 0
    for i, data in enumerate(records):
        want, error = cbor.decode_record(data)
        row = got[i]
        if want is None:
            bad += 1
            # a payload that is wrong inside is for whoever reads the payload
            assert row["decode_error"] or not isinstance(_payload_error(bytes(row["payload"])), dict)
        else:
            assert row["decode_error"] is None, (i, data.hex())
            fields = [int(row["record_id"]), bytes(row["prev_hash"]), row["ts_wall"], int(row["ts_mono_delta"]), bytes(row["session_id"]), row["actor"], row["event"], bytes(row["payload"]), bytes(row["key_id"]), row["schema_version"]]
            assert fields == [want[k] if k != 8 else cbor.encode(want[8]) for k in range(1, 11)]
    return bad


def _payload_error(data):
    try:
        value = cbor.decode(data)
    except cbor.LogFormatError:
        return None
    return value if isinstance(value, dict) and all(isinstance(k, str) for k in value) else None


def test_random_records(spark):
    rng = random.Random(5)
    assert compare(spark, [record(rng) for _ in range(10_000)]) == 0


def test_damaged_records(spark):
    rng = random.Random(6)
    damaged = []
    for _ in range(4000):
        data = bytearray(record(rng))
        for _ in range(rng.randrange(1, 3)):
            at = rng.randrange(len(data)) if rng.random() < 0.5 else rng.randrange(min(len(data), 60))
            how = rng.randrange(3)
            if how == 0:
                data[at] ^= 1 << rng.randrange(8)
            elif how == 1:
                del data[at]
            else:
                data.insert(at, rng.randrange(256))
        damaged.append(bytes(data))
    assert compare(spark, damaged + [b"", b"\xaa", b"\xaa\x01", record(rng)[:-1]]) > 500


def test_null_bytes_have_no_error(spark):
    r = parsed(spark.createDataFrame([(None,)], "payload_bytes binary")).first()
    assert [r[c] for c in FIELDS] == [None] * len(FIELDS)


def test_reading_queries_decode_in_the_jvm(spark):
    """Sealing is the one Python step of these plans; nothing behind it is."""
    for name in ("show_range", "show_actor", "show_event_glob", "show_combined", "head_per_log", "segment_summary", "first_and_last", "seek_record"):
        plan = p.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1, name  # the seal


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(record(random.Random(1)), 1, "x")], "payload_bytes binary, n int, at string")
    assert parsed(df).columns == ["payload_bytes", "n", "at", *FIELDS]
    assert parsed(df).select(F.col("at")).first()[0] == "x"
