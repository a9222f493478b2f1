import pytest
from pyspark.sql import functions as F

from sealwright.functions import cbor
from sealwright.keys import LocalKey
from sealwright.operators.seal import record_inputs

from . import vectors as v


@pytest.fixture(scope="session")
def key():
    return LocalKey(v.SECRET)


@pytest.fixture()
def make_inputs(spark):
    """Record inputs of (log_id, seq, second, event, payload)."""

    def make(rows):
        df = spark.createDataFrame([(log, i, f"2026-05-10T12:{s // 60:02d}:{s % 60:02d}.000Z", s * 1000, "user:david", e, cbor.encode(p)) for log, i, s, e, p in rows], "log string, i long, ts string, mono long, actor string, event string, payload binary")
        return record_inputs(df, F.col("log"), F.col("i"), F.col("ts"), F.col("mono"), F.col("actor"), F.col("event"), F.col("payload"))

    return make


@pytest.fixture()
def vector_inputs(make_inputs):
    return make_inputs([("log", i, i, e, p) for i, (e, p) in enumerate(v.INPUTS)])
