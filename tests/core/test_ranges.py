"""The index and reading by ranges: equal to reading whole files, and of few bytes."""

import os

import pytest
from pyspark.sql import functions as F

from sealwright.functions.records import parsed
from sealwright.operators import query as q
from sealwright.operators.seal import SealConfig, record_inputs, seal
from sealwright.sources import ranges as r
from sealwright.sources.segments import FRAMES, filesystem, list_segments, read_log, write_segments

from . import vectors as v


@pytest.fixture(scope="module")
def store(spark, key, tmp_path_factory):
    """Three logs of 3,000 records, in segments of 200 kB; log2's events are many."""
    folder = str(tmp_path_factory.mktemp("ranges") / "store")
    os.makedirs(folder)
    d = spark.range(9000).select(F.concat(F.lit("log"), F.col("id") % 3).alias("log"), F.floor(F.col("id") / 3).alias("i"))
    ts = F.date_format(F.timestamp_millis(1_700_000_000_000 + F.col("i") * 1000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    event = F.when(F.col("log") == "log2", F.concat(F.lit("e."), "i")).otherwise(F.concat(F.lit("e."), F.floor(F.col("i") / 500)))
    i = record_inputs(d, F.col("log"), F.col("i"), ts, F.col("i") * 1000, F.concat(F.lit("user:"), F.floor(F.col("i") / 700)), event, F.lit(b"\xa0"))
    write_segments(seal(i, key, v.SESSION, SealConfig(200_000)), folder, key.key_id).collect()
    r.build_index(spark, folder, 10_000)
    return folder


def rows(df):
    return sorted((x["log_id"], x["segment_index"], x["file_offset"], bytes(x["hmac"]).hex()) for x in df.collect())


WANTED = [
    r.Wanted("log1", 1, 7, 8),
    r.Wanted(start=100, end=104),
    r.Wanted(actor="user:3", event="e.4"),
    r.Wanted(actor_contains="r:1", event_glob="e.?"),
    r.Wanted(log_id="log2", event="e.1234"),
    r.Wanted(ts_from="2023-11-14T22:20:00.000Z", ts_to="2023-11-14T22:21:00.000Z"),
    r.Wanted(event="none"),
]


@pytest.mark.parametrize("wanted", WANTED)
def test_found_by_ranges_as_by_reading_all(spark, store, wanted):
    got = rows(r.find(spark, store, wanted))
    assert got == rows(parsed(read_log(spark, store)[0]).filter(wanted.records()))
    assert bool(got) == (wanted.event != "none")
    planned = r.ranges(spark, store, wanted).agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    total = r.segment_files(spark, store).agg(F.sum("file_bytes")).first()[0]
    assert planned < total * 0.45


def test_files_are_listed_in_tasks(spark, store, tmp_path):
    """No file's row is in a plan, and one listing serves both kinds of ranges."""
    for name in ("audit-0000.cbor", "a/audit-0007.cbor", "a/b/c/audit-0001.cbor", "a/b/c/old-audit-0001.cbor", "d/audit-1.cbor"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(bytes(len(name)))
    for folder in (store, str(tmp_path), f"{tmp_path}/"):
        files = r.segment_files(spark, folder)
        assert sorted(map(tuple, files.collect())) == list_segments(folder)
        plan = r.ranges(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert "LocalRelation" not in plan and plan.count("LogicalRDD") == 1
    assert [(log, seg) for log, seg, _, _ in list_segments(str(tmp_path))] == [("a", 7), ("a/b/c", 1), (tmp_path.name, 0)]


def test_a_store_is_read_without_a_listing_in_the_driver(spark, store):
    """And by the rows that the data source gives, which deals files in the driver."""
    from sealwright.sources import segments

    spark.dataSource.register(segments.AuditLogs)
    source = spark.read.format("audit_logs")
    plain = sorted(map(tuple, source.load(store).collect())), sorted(map(tuple, source.option("rows", "segments").load(store).collect()))
    frames, heads = read_log(spark, store)
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (frames, heads)]
    assert all("LogicalRDD" in p and "RelationV2" not in p for p in plans)
    assert (sorted(map(tuple, frames.collect())), sorted(map(tuple, heads.collect()))) == plain
    assert {x["segment_index"] for x in read_log(spark, store, 1, 2)[1].collect()} == {1, 2}


def test_a_seek_reads_under_one_percent(spark, store):
    """Bytes that the source hands out, counted at the file."""
    wanted = r.Wanted("log1", 1, 7, 8)
    counts = []

    class Counted:
        def __init__(self, source):
            self.source = source

        def size(self):
            return self.source.size()

        def seek(self, at):
            self.source.seek(at)

        def read(self, n):
            counts.append(n)
            return self.source.read(n)

    for x in r.ranges(spark, store, wanted).collect():
        fs, at = filesystem(x["path"])
        with fs.open_input_file(at) as source:
            assert [f for f in r.frames_between(Counted(source), x["start"], x["end"])]
    total = r.segment_files(spark, store).agg(F.sum("file_bytes")).first()[0]
    assert 0 < sum(counts) < total / 100
    assert r.find(spark, store, wanted).count() == 1


def test_reading_in_ranges_and_pieces_gives_all_frames(spark, store, monkeypatch):
    whole = rows(read_log(spark, store)[0])
    assert rows(r.read_ranges(r.ranges(spark, store))) == whole
    path = r.segment_files(spark, store).first()["path"]
    fs, at = filesystem(path)
    for piece in (1, 300, 5000):
        monkeypatch.setattr(r, "PIECE", piece)
        with fs.open_input_file(at) as source:
            assert sum(1 for _ in r.frames_between(source, 80, source.size())) == sum(1 for x in whole if path.endswith(f"{x[0]}/audit-{x[1]:04d}.cbor"))


def test_changed_files_are_read_whole_and_indexed_again(spark, key, make_inputs, tmp_path):
    folder = str(tmp_path / "store")
    os.makedirs(folder)
    i = make_inputs([("a", i, i, "e.x", {"i": i}) for i in range(30)])
    write_segments(seal(i, key, v.SESSION), folder, key.key_id).collect()
    assert r.build_index(spark, folder, 1000).count() > 3
    path = f"{folder}/a/audit-0000.cbor"
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-100])
    got = r.read_ranges(r.ranges(spark, folder))
    assert rows(got.filter("not torn")) == rows(read_log(spark, folder)[0].filter("not torn"))
    assert got.filter("torn").count() == 1
    before = r.read_index(spark, folder).count()
    r.build_index(spark, folder, 1000)
    assert r.build_index(spark, folder, 1000).count() > before
    assert r.find(spark, folder, r.Wanted(start=3, end=5)).count() == 2


def test_heads_from_tails(spark, key, store, make_inputs, tmp_path):
    want = q.head(parsed(read_log(spark, store)[0]), ["log_id"])
    got = q.heads_of_files(spark, store)
    assert got.columns == want.columns
    assert sorted(got.collect()) == sorted(want.collect())
    # a torn end, an empty segment, a file that is too short
    folder = str(tmp_path / "store")
    os.makedirs(folder)
    write_segments(seal(make_inputs([("a", i, i, "e.x", {"i": i}) for i in range(30)]), key, v.SESSION), folder, key.key_id).collect()
    path = f"{folder}/a/audit-0000.cbor"
    data = open(path, "rb").read()
    os.makedirs(f"{folder}/b")
    for torn in (data[:-1], data[:-37], data[:200]):
        open(path, "wb").write(torn)
        open(f"{folder}/b/audit-0000.cbor", "wb").write(data[:80])
        want = q.head(parsed(read_log(spark, folder)[0].filter("not torn")), ["log_id"])
        assert sorted(q.heads_of_files(spark, folder).collect()) == sorted(want.collect())


def test_blooms():
    data = r.bloom([f"v{i}" for i in range(60)])
    assert len(data) == r.BLOOM_BYTES
    assert all(data[byte] >> bit & 1 for i in range(60) for byte, bit in r.bloom_places(f"v{i}"))


def test_frames_of_an_empty_range(spark):
    assert spark.createDataFrame([], FRAMES).count() == 0
