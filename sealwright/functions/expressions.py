"""Column functions of the record format: heads, fields, hashes, times, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FORMAT_VERSION, MAGIC


def be_bytes(n: Column, size: int) -> Column:
    """The unsigned integer as so many big-endian bytes."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))


def le_bytes(n: Column, size: int) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * (size - i) - 1, 2) for i in range(size)]))


def cbor_head(major: int, n: Column) -> Column:
    """The shortest head of a major type and a length or value below 2 ** 63."""
    base = major << 5
    return (
        F.when(n < 24, be_bytes(n + base, 1))
        .when(n < 1 << 8, F.concat(F.lit(bytes([base + 24])), be_bytes(n, 1)))
        .when(n < 1 << 16, F.concat(F.lit(bytes([base + 25])), be_bytes(n, 2)))
        .when(n < 1 << 32, F.concat(F.lit(bytes([base + 26])), be_bytes(n, 4)))
        .otherwise(F.concat(F.lit(bytes([base + 27])), be_bytes(n, 8)))
    )


def cbor_uint(n: Column) -> Column:
    return cbor_head(0, n.cast("long"))


def cbor_text(text: Column) -> Column:
    return F.concat(cbor_head(3, F.octet_length(text).cast("long")), F.encode(text, "UTF-8"))


def cbor_bytes(data: Column) -> Column:
    return F.concat(cbor_head(2, F.octet_length(data).cast("long")), data)


def cbor_text_map(pairs: list[tuple[str, Column]]) -> Column:
    """A map of fixed text keys to encoded values, in canonical order."""
    ordered = sorted(pairs, key=lambda p: (len(p[0].encode()), p[0].encode()))
    return F.concat(F.lit(bytes([0xA0 + len(ordered)])), *[c for k, v in ordered for c in (cbor_text(F.lit(k)), v)])


def record_tail(ts_wall: Column, ts_mono: Column, session: bytes, actor: Column, event: Column, payload: Column, key_id: bytes, version: Column) -> Column:
    """A record's canonical bytes behind prev_hash: fields 3 to 10."""
    parts = [(3, cbor_text(ts_wall)), (4, cbor_uint(ts_mono)), (5, cbor_bytes(F.lit(session))), (6, cbor_text(actor)), (7, cbor_text(event)), (8, payload), (9, cbor_bytes(F.lit(key_id))), (10, cbor_uint(version))]
    return F.concat(*[c for k, v in parts for c in (F.lit(bytes([k])), v)])


def record_bytes(record_id: Column, prev_hash: Column, tail: Column) -> Column:
    """A record's canonical bytes: a map of ten, record_id, prev_hash, and the tail."""
    return F.concat(F.lit(b"\xaa\x01"), cbor_uint(record_id), F.lit(b"\x02\x58\x20"), prev_hash, tail)


def hmac_sha256(secret: bytes, data: Column) -> Column:
    """HMAC as two nested hashes, all in the JVM. The key becomes part of the plan, so use it for public keys only."""
    block = secret.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, data), 256))), 256))


def header_body(segment_index: Column, key_id: bytes, prev_final: Column) -> Column:
    """The 72 bytes of a segment header that its CRC covers."""
    return F.concat(F.lit(MAGIC), le_bytes(F.lit(FORMAT_VERSION), 2), le_bytes(segment_index, 2), F.lit(key_id), prev_final)


def header_bytes(segment_index: Column, key_id: bytes, prev_final: Column) -> Column:
    body = header_body(segment_index, key_id, prev_final)
    return F.concat(body, le_bytes(F.crc32(body), 4), F.lit(bytes(4)))


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def ts_millis(ts_wall: Column) -> Column:
    """Milliseconds of a signed time. Not 24 bytes: 0; a part that isn't a number: 0 for that part; days aren't checked.

    Well-formed times are cast; the arithmetic is for the others, row by row as needed.
    """
    plain = F.when(ts_wall.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z\z"), F.unix_millis(ts_wall.try_cast("timestamp")))
    return F.coalesce(plain, _ts_millis_by_parts(ts_wall))


def _ts_millis_by_parts(ts_wall: Column) -> Column:
    part = lambda at, n: F.coalesce(F.when(F.substring(ts_wall, at, n).rlike(r"^\+?\d+$"), F.substring(ts_wall, at, n).try_cast("long")), F.lit(0))
    y0, m, d = part(1, 4), part(6, 2), part(9, 2)
    y = F.when(m <= 2, y0 - 1).otherwise(y0)
    era = F.floor(y / 400)
    yoe = y - era * 400
    doy = F.floor((153 * F.when(m > 2, m - 3).otherwise(m + 9) + 2) / 5) + d - 1
    days = era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468
    ms = ((days * 24 + part(12, 2)) * 60 + part(15, 2)) * 60 * 1000 + part(18, 2) * 1000 + part(21, 3)
    return F.when(F.octet_length(ts_wall) == 24, ms.cast("long")).otherwise(F.lit(0).cast("long"))


def iso_millis(ts: Column) -> Column:
    """A timestamp as the format writes it, in UTC with milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def bump_millisecond(ts_wall: Column) -> Column:
    """One millisecond later, with the carry."""
    later = F.timestamp_millis(ts_millis(ts_wall) + 1)
    return F.when(F.octet_length(ts_wall) == 24, iso_millis(later)).otherwise(ts_wall)


def glob(text: Column, pattern: str) -> Column:
    """Whether the whole text matches; * is any run of characters, ? is one, nothing else is special."""
    return text.rlike("(?s)^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern) + r"\z")


def compact_verdict(kind: Column, segment_index: Column, record_id: Column) -> Column:
    """Verified, <Kind>@s<N>r<M> or <Kind>@s<N>."""
    at = F.concat(kind, F.lit("@s"), segment_index.cast("string"), F.when(record_id.isNotNull(), F.concat(F.lit("r"), record_id.cast("string"))).otherwise(F.lit("")))
    return F.coalesce(at, F.lit("Verified"))


def summary_line(ok: Column, n: Column, head_hex: Column, kind: Column, segment_index: Column, record_id: Column) -> Column:
    good = F.concat(F.lit("✓ Verified · "), n.cast("string"), F.lit(" events · chain head "), F.coalesce(F.substring(head_hex, 1, 8), F.lit("-")))
    bad = F.concat(F.lit("✗ Verification failed · "), kind, F.lit(" at segment "), segment_index.cast("string"), F.lit(" record "), F.coalesce(record_id.cast("string"), F.lit("-")))
    return F.when(ok, good).otherwise(bad)
