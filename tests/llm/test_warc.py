import base64
import hashlib
import io

import pytest

from sealwright.llm import warc
from sealwright.llm.shared import shared_folder

SCHEMA = "page_id long, url string, html string, payload string"


def brute(pages, min_bytes):
    first = {}
    for page_id, _, html in pages:
        body = (html or "").encode()
        if len(body) >= min_bytes and page_id is not None:
            first[body] = min(first.get(body, page_id), page_id)
    out = []
    for page_id, _, html in pages:
        body = (html or "").encode()
        f = first.get(body)
        revisit = f is not None and f != page_id
        out.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_against_brute_force(spark, rng, min_bytes):
    pages = [(i, f"http://x.example/{i}", f"<p>{rng.choice('abc') * rng.randrange(4)}</p>" if i % 3 else rng.choice(["same", "", None])) for i in range(300)]
    pages += [(400, None, "y" * 500_000), (401, "http://a\r\nWARC-Type: evil", "é\r\n\r\nWARC/1.1"), (7, "u", "repeated row"), (7, "u", "repeated row"), (None, "n", "no id"), (None, "n", "same"), (402, "", "z")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], SCHEMA)
    got = warc.archive_and_read(spark, df, min_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(pages, min_bytes)
    assert warc.archive_and_read(spark, df.limit(0)).collect() == []


def test_files_are_frames_behind_a_dictionary(spark):
    import glob

    import zstandard

    folder = shared_folder(spark, "warc-test")
    df = spark.createDataFrame([(i, "u", f"<html>{'common words of every page ' * 40}{i}</html>", None) for i in range(2000)], SCHEMA)
    warc.write_warc(df.coalesce(1), folder).collect()
    for path in glob.glob(folder.removeprefix("file://") + "/*"):
        data = open(path, "rb").read()
        assert data[:4] == bytes.fromhex("5d2a4d18")
        size = int.from_bytes(data[4:8], "little")
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        one = d.decompressobj()
        record = one.decompress(data[8 + size :])  # a record alone, by its offset
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: response") and one.eof
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(data[:-3])))


def test_damage_is_found():
    record = warc.record_bytes(1, "u", b"body", "X", None, "d")
    with pytest.raises(ValueError):
        warc.parsed(record.replace(b"body", b"bodyy"))


def test_a_hot_digest_meets_ids_only(spark, rng):
    """A third of all pages equal: labels by brute force, and the join by digest carries neither urls nor payloads."""
    pages = [(i, f"u{i}", "blocked" if i % 3 else f"page {i} {rng.random()}") for i in range(3000)]
    df = spark.createDataFrame([(*p, None) for p in pages], SCHEMA)
    got = {r["page_id"]: r["refers_to"] for r in warc.label(df, 0).select("page_id", "refers_to").collect()}
    assert got == {i: 1 if i % 3 and i != 1 else None for i in range(3000)}
    plan = warc.label(df, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "warc-revisits" in str(warc.label(df, 0).inputFiles())
