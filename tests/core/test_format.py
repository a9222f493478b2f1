import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from sealwright.errors import KeyLoadError, LogFormatError, SigningError
from sealwright.functions import cbor
from sealwright.functions import expressions as x
from sealwright.keys import LocalKey, RemoteKey, blake3

from . import vectors as v

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_blake3_and_key_ids():
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert LocalKey(v.SECRET).key_id.hex() == v.KEY_ID
    assert LocalKey(bytes(32)).key_id.hex() == "2ada83c1819a5372dae1238fc1ded123c8104fdaa15862aaee69428a1820fcda"


def test_key_sources(tmp_path, monkeypatch):
    monkeypatch.setenv("A_KEY", v.SECRET.hex())
    path = tmp_path / "key"
    path.write_bytes(v.SECRET)
    path.chmod(0o600)
    assert {LocalKey.from_env("A_KEY").key_id, LocalKey.from_file(str(path)).key_id, LocalKey.from_hex(v.SECRET.hex()).key_id} == {bytes.fromhex(v.KEY_ID)}
    path.chmod(0o640)
    for bad in (lambda: LocalKey.from_file(str(path)), lambda: LocalKey.from_hex("zz"), lambda: LocalKey(b"short"), lambda: LocalKey.from_env("NO_SUCH")):
        with pytest.raises(KeyLoadError):
            bad()
    assert v.SECRET.hex() not in repr(LocalKey(v.SECRET)) and v.KEY_ID[:8] in repr(LocalKey(v.SECRET))


class FakeClient:
    provider_name, descriptor, failures = "fake", " Key/One ", 1

    def sign(self, data):
        if FakeClient.failures:
            FakeClient.failures -= 1
            raise SigningError("throttled", retryable=True)
        return LocalKey(v.SECRET).sign(data)

    def unwrap(self):
        return v.SECRET


def test_remote_keys_retry_and_unwrap():
    key = RemoteKey(FakeClient, b"domain/v1\n")
    assert key.sign(b"x") == LocalKey(v.SECRET).sign(b"x") and key.key_id == blake3(b"domain/v1\nfake\nkey/one")
    assert key.local().sign(b"x") == key.sign(b"x") and key.local().key_id == key.key_id


@pytest.mark.parametrize("value", [0, 23, 24, 255, 256, 65535, 65536, 2**32, 2**64 - 1, -1, -25, -(2**63), b"", b"x" * 300, "", "é" * 40, True, False, [], [1, [b"a", {"k": False}]], {}, {"bb": 1, "a": 2, "ccc": {"z": [1, 2, "three"]}}])
def test_cbor_round_trip(value):
    assert cbor.decode(cbor.encode(value)) == value


@pytest.mark.parametrize("data", ["", "1817", "190001", "f6", "f97e00", "c100", "5f", "61ff", "a2616201616101", "a2616101616102", "0000", "4201", "3bffffffffffffffff", "81" * 16 + "00"])
def test_cbor_refuses(data):
    with pytest.raises(LogFormatError):
        cbor.decode(bytes.fromhex(data))


def test_cbor_depth_and_types():
    assert cbor.decode(bytes.fromhex("81" * 15 + "00"))
    for bad in (1.5, None, {1, 2}):
        with pytest.raises(TypeError):
            cbor.encode(bad)


def test_heads_in_the_jvm_equal_the_codec(spark):
    numbers = [0, 1, 23, 24, 255, 256, 65535, 65536, 2**32 - 1, 2**32, 2**53, 2**63 - 1]
    texts = ["", "a", "é" * 12, "x" * 23, "x" * 24, "y" * 255, "y" * 256, "z" * 70_000]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", x.cbor_uint(F.col("n"))).collect()
    assert all(bytes(b) == cbor.encode(n) for n, b in got)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", x.cbor_text(F.col("t"))).collect()
    assert all(bytes(b) == cbor.encode(t) for t, b in got)
    (row,) = spark.range(1).select(x.cbor_text_map([("bb", x.cbor_uint(F.lit(1))), ("a", x.cbor_text(F.lit("q")))])).collect()
    assert bytes(row[0]) == cbor.encode({"bb": 1, "a": "q"})


def test_hmac_crc_and_times(spark):
    data = [os.urandom(n) for n in (0, 1, 63, 64, 65, 500)]
    rows = spark.createDataFrame([(d,) for d in data], "d binary").select("d", x.hmac_sha256(v.SECRET, F.col("d"))).collect()
    assert all(bytes(h) == LocalKey(v.SECRET).sign(bytes(d)) for d, h in rows)
    times = {"2026-05-10T12:00:00.000Z": 1778414400000, "1970-01-01T00:00:00.001Z": 1, "2024-02-29T23:59:59.999Z": 1709251199999, "short": 0, "1969-12-31T23:59:59.999Z": -1}
    rows = spark.createDataFrame([(t,) for t in times], "t string").select("t", x.ts_millis(F.col("t")), x.bump_millisecond(F.col("t"))).collect()
    assert {t: n for t, n, _ in rows} == times
    bumped = {t: b for t, _, b in rows}
    assert bumped["2024-02-29T23:59:59.999Z"] == "2024-03-01T00:00:00.000Z" and bumped["short"] == "short"


@pytest.mark.parametrize(("pattern", "yes", "no"), [("event.*", ["event.", "event.a\nb"], ["Event.a", "xevent."]), ("a?c", ["abc", "aéc"], ["ac", "abbc"]), ("[a].*", ["[a].x"], ["a.x"]), ("*", ["", "x"], []), ("", [""], ["x"]), ("a.b\\", ["a.b\\"], ["axb\\"])])
def test_glob(spark, pattern, yes, no):
    df = spark.createDataFrame([(t,) for t in yes + no], "t string")
    assert sorted(r[0] for r in df.filter(x.glob(F.col("t"), pattern)).collect()) == sorted(yes)


def test_the_library_works_without_the_llm_subpackage():
    code = "import sys, importlib.abc\nclass Block(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path, target=None):\n        if name.startswith('sealwright.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, Block())\nimport __spark_entry__ as e\nassert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())\nassert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=HERE, check=True)


def test_random_payloads_round_trip():
    rng = random.Random(1)

    def value(depth=0):
        kind = rng.randrange(7 if depth < 3 else 5)
        return [rng.randrange(2**64), -rng.randrange(1, 2**63), rng.random() < 0.5, "".join(rng.choice("aé日z") for _ in range(rng.randrange(30))), os.urandom(rng.randrange(30))][kind] if kind < 5 else [value(depth + 1) for _ in range(3)] if kind == 5 else {str(rng.random()): value(depth + 1) for _ in range(3)}

    for _ in range(500):
        x_ = {"k": value()}
        assert cbor.decode(cbor.encode(x_)) == x_
