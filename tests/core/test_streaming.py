"""Sealing streams to files: equal to the batch, each epoch once over crashes, and in bounded memory."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sealwright.errors import SealError
from sealwright.operators.seal import SealConfig, record_inputs, seal
from sealwright.operators.verify import verify
from sealwright.sources.segments import AuditLogs, list_segments, read_log, write_segments
from sealwright.sources.sink import Part, SegmentSink, Written
from sealwright.streaming.tail import in_order, seal_stream, write_sealed

from . import vectors as v

SMALL = SealConfig(segment_bytes=1024)


class BreaksBeforeDeciding(SegmentSink):
    def decide(self, batch_id, parts):
        if batch_id == 1:
            raise RuntimeError("killed before the manifest")
        super().decide(batch_id, parts)


class BreaksBetweenRenames(SegmentSink):
    def put_in_place(self, parts):
        if self.epoch(1) is not None:
            super().put_in_place(parts[: len(parts) // 2])
            raise RuntimeError("killed between renames")
        super().put_in_place(parts)


class FailsInTasks(SegmentSink):
    def write(self, iterator):
        message = super().write(iterator)
        if any(p.start > 80 or p.segment_index for p in message.parts):
            raise RuntimeError("killed after writing")
        return message


def source(sink):
    class Broken(AuditLogs):
        @classmethod
        def name(cls):
            return "broken_logs"

        def streamWriter(self, schema, overwrite):
            return sink(self.options)

    return Broken


def bytes_of(folder):
    return {(log, seg): open(path.removeprefix("file://"), "rb").read() for log, seg, path, _ in list_segments(str(folder))}


@pytest.fixture()
def two_batches(spark, make_inputs, tmp_path):
    rows = [(f"log{k}", i, i, "s.tick", {"i": i}) for k in range(5) for i in range(10)]
    d = make_inputs(rows)
    for name, part in (("1", "seq < 4"), ("2", "seq >= 4")):
        d.filter(part).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    return d, stream


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination(240)


def test_files_of_a_stream_are_those_of_the_batch(spark, key, two_batches, tmp_path):
    d, stream = two_batches
    write_segments(seal(d, key, v.SESSION, SMALL), str(tmp_path / "batch"), key.key_id).collect()
    run(write_sealed(seal_stream(stream, key, v.SESSION, SMALL), str(tmp_path / "stream"), key.key_id, str(tmp_path / "cp")))
    assert bytes_of(tmp_path / "stream") == bytes_of(tmp_path / "batch")
    assert {r["compact"] for r in verify(*read_log(spark, str(tmp_path / "stream")), key).collect()} == {"Verified"}
    assert sorted(os.listdir(tmp_path / "stream" / "_sealed" / "epochs")) == ["0.json", "1.json"]


@pytest.mark.parametrize("sink", [BreaksBeforeDeciding, BreaksBetweenRenames, FailsInTasks])
def test_a_killed_stream_goes_on_with_equal_bytes(spark, key, two_batches, tmp_path, sink):
    d, stream = two_batches
    write_segments(seal(d, key, v.SESSION, SMALL), str(tmp_path / "batch"), key.key_id).collect()
    spark.dataSource.register(source(sink))
    writer = lambda: write_sealed(seal_stream(stream, key, v.SESSION, SMALL), str(tmp_path / "stream"), key.key_id, str(tmp_path / "cp"))
    with pytest.raises(Exception, match="killed"):
        run(writer().format("broken_logs"))
    # what there is, if anything, verifies: whole epochs of each log
    assert {r["compact"] for r in verify(*read_log(spark, str(tmp_path / "stream")), key).collect()} <= {"Verified"}
    run(writer())
    assert bytes_of(tmp_path / "stream") == bytes_of(tmp_path / "batch")
    assert os.listdir(tmp_path / "stream" / "_sealed" / "parts") == []


def test_an_epoch_with_other_rows_is_refused(tmp_path):
    sink = SegmentSink({"path": str(tmp_path), "key_id": "00" * 32})
    os.makedirs(tmp_path / "_sealed" / "parts")
    part = lambda head: Part("a", 0, 80, 90, head, "x" + head)
    for _ in range(2):
        (tmp_path / "_sealed" / "parts" / "x1").write_bytes(b"y" * 90)
        sink.commit([Written([part("1")]), None], 0)
    with pytest.raises(SealError):
        sink.commit([Written([part("2")])], 0)
    assert (tmp_path / "a" / "audit-0000.cbor").read_bytes() == b"y" * 90


def test_abort_drops_the_parts(tmp_path):
    os.makedirs(tmp_path / "_sealed" / "parts")
    (tmp_path / "_sealed" / "parts" / "p").write_bytes(b"")
    SegmentSink({"path": str(tmp_path), "key_id": "00" * 32}).abort([None, Written([Part("a", 0, 80, 90, "", "p"), Part("a", 1, 80, 90, "", "gone")])], 3)
    assert os.listdir(tmp_path / "_sealed" / "parts") == []


def test_rows_are_merged_from_runs(tmp_path):
    rng = random.Random(3)
    seqs = rng.sample(range(100_000), 35_000)
    batches = [pd.DataFrame({"seq": seqs[i : i + 700], "tail": [b"%d" % s for s in seqs[i : i + 700]]}) for i in range(0, len(seqs), 700)]
    out = pd.concat(in_order(iter(batches), "seq", f"file://{tmp_path}/runs", 5000))
    assert out["seq"].tolist() == sorted(seqs) and out["tail"].tolist() == [b"%d" % s for s in sorted(seqs)]
    assert os.listdir(tmp_path / "runs") == []
    with pytest.raises(SealError):
        list(in_order(iter(batches), "seq", None, 5000))


def test_a_large_batch_of_one_log(spark, key, tmp_path):
    """More rows of a log than a task holds: the chain is the batch's."""
    rows = spark.range(30_000).select(F.lit("one").alias("log"), (F.col("id") * 7919 % 30_000).alias("i"))
    d = record_inputs(rows, F.col("log"), F.col("i"), F.lit("2026-05-10T12:00:00.000Z"), F.lit(0), F.lit("a"), F.lit("e.x"), F.lit(b"\xa0"))
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    sealed = seal_stream(stream, key, v.SESSION, held_rows=6000, runs=f"file://{tmp_path}/runs")
    run(write_sealed(sealed, str(tmp_path / "stream"), key.key_id, str(tmp_path / "cp")))
    write_segments(seal(d, key, v.SESSION), str(tmp_path / "batch"), key.key_id).collect()
    assert bytes_of(tmp_path / "stream") == bytes_of(tmp_path / "batch")
    assert os.listdir(tmp_path / "runs") == []
