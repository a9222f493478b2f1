"""WARC archives of pages: records compressed one by one with a dictionary that leads the file.

Each file begins with a skippable frame that holds a zstandard dictionary built from the file's own records; every
record is a frame of its own, so it can be read alone by its offset. Pages whose payload was archived already become
revisit records that name the response. One task writes one file; nothing is gathered on the driver.
"""

from __future__ import annotations

import base64
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import attempt_name, filesystem, pieces, shared_folder, written

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file's dictionary is built from at most so many bytes of its first records, and is at most so long.
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 64 << 10


def base32_digest(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A whole record. URLs' control characters are percent-encoded; a revisit has the HTTP head without the payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(record: bytes) -> dict:
    """page_id, url, record_type, refers_to, digest, payload (None for a revisit) and payload_bytes of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a record: {version[:20]}")
    fields = dict(x.split(": ", 1) for x in lines)
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    number = lambda key: int(x) if (x := fields.get(key, "<urn:x-page:>")[12:-1]) else None
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": None if revisit else payload, "payload_bytes": int(http.rsplit(b"Content-Length: ", 1)[1]),
    }


def dictionary_of(records: list[bytes]) -> bytes:
    """A trained dictionary; where the records are too few to train on, their last bytes as raw content."""
    import zstandard

    total = sum(map(len, records))
    try:
        if len(records) >= 16 and total >= 8 * DICTIONARY_BYTES:
            return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        pass
    return b"".join(records)[-min(DICTIONARY_BYTES, max(total // 8, 8)) :]


def label(pages: DataFrame, min_bytes: int) -> DataFrame:
    """pages with payload (binary), sha1 and refers_to: the smallest page_id with an equal payload of at least min_bytes, null for itself.

    The smallest id of each digest that occurs twice or more is pre-aggregated before its shuffle and written, then ids
    alone are joined with it: both sides are tables, so that Spark's skew join splits a digest that a third of all pages
    have, and its rows are narrow. Payloads move once, by page_id and digest, which only repeated rows share.
    """
    key = ["sha1", "size"]
    p = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload"))
    ids = written(p.select("page_id", *key), "warc-digests")
    firsts = ids.filter(F.col("size") >= min_bytes).groupBy(*key).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = ids.join(written(firsts, "warc-firsts"), key).filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("id"), *[F.col(c).alias(f"of_{c}") for c in key], F.col("first").alias("refers_to"))
    revisits = written(revisits.distinct(), "warc-revisits")
    same = F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha1") == F.col("of_sha1")) & (F.col("size") == F.col("of_size"))
    return p.join(revisits, same, "left").select("page_id", "url", "payload", "sha1", "refers_to")


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Archives of all pages (page_id, url, html); returns the manifest (path, records).

    Of records with equal payloads of at least min_bytes, those with the smallest page_id are responses and the others
    revisit it (rows that repeat that id too are responses); smaller payloads are always responses. Null html is
    empty, a null url has no target field, and a null page_id has an empty id (it counts as larger than any id).
    """

    def write(batches):
        import pyarrow as pa
        import zstandard

        out = path = compressor = None
        n, held, held_bytes = 0, [], 0

        def begin():
            nonlocal out, path, compressor
            fs, base = filesystem(folder)
            path = f"{folder}/{attempt_name('pages', '.warc.zst')}"
            out = fs.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}", compression=None)  # the name would else ask for compression of the whole
            content = dictionary_of(held)
            out.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
            compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=True, write_checksum=True)
            for record in held:
                out.write(compressor.compress(record))
            held.clear()

        for batch in pieces(batches, "payload"):
            for page_id, url, payload, sha1, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to"))):
                record = record_bytes(page_id, url, payload, base64.b32encode(sha1).decode(), refers_to, date)
                n += 1
                if out:
                    out.write(compressor.compress(record))
                else:
                    held.append(record)
                    held_bytes += len(record)
                    if held_bytes >= SAMPLE_BYTES:
                        begin()
        if n:
            if not out:
                begin()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    return written(label(pages, min_bytes).mapInArrow(write, "path string, records long"), "warc-manifest")


def records(source):
    """The records of an open archive, in order, decompressed one frame at a time."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the file doesn't begin with a dictionary")
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(size)))
    held = b""
    while True:
        frame = decompressor.decompressobj()
        parts = []
        while not frame.eof:
            if not held and not (held := source.read(1 << 20)):
                if parts:
                    raise ValueError("the last frame is cut short")
                return
            parts.append(frame.decompress(held))
            held = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def read_warc(manifest: DataFrame) -> DataFrame:
    """A row per record of the archives, with the payload's digest as computed again where the record has the payload."""

    def read(batches):
        import hashlib

        import pyarrow as pa

        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], list(kinds))

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as source:
                    for record in records(source):
                        r = parsed(record)
                        if r["payload"] is not None and (len(r["payload"]) != r["payload_bytes"] or base32_digest(hashlib.sha1(r["payload"]).hexdigest()) != r["digest"]):
                            raise ValueError(f"page {r['page_id']} is damaged")
                        rows.append(r | {"payload_digest": r["digest"]})
                        held += len(record)
                        if held >= 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = manifest.select("path").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2), "path")
    return files.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_and_read(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    return read_warc(write_warc(pages, shared_folder(spark, "warc"), min_bytes))
