"""Records parsed in the JVM: the ten fields of a record's bytes, found head by head in their fixed order.

A record is a map of ten with keys 1 to 10, and canonical: each head is the shortest, so every field's place follows from
the ones before. The payload (field 8), whose shape is open, is cut out as bytes between field 7 and the last two fields,
whose lengths are known; what is inside it isn't looked at here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import HASH_BYTES, SESSION_BYTES

FIELDS = ("record_id", "prev_hash", "ts_wall", "ts_mono_delta", "session_id", "actor", "event", "payload", "key_id", "schema_version", "decode_error")
BAD = "not a canonical record"
_DATA = "payload_bytes"


def _cut(at: Column, n: Column | int) -> Column:
    return F.substring(F.col(_DATA), at + 1, n if isinstance(n, Column) else F.lit(n))


def _is(at: Column, what: bytes) -> Column:
    return _cut(at, len(what)) == F.lit(what)


def _step(d: DataFrame, **columns: Column) -> DataFrame:
    """d with columns that are computed once a row: as a generator's output they are never put into later expressions.

    Each place depends several times on the one before, so that expressions put into one another would grow exponentially.
    """
    return d.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _with_head(d: DataFrame, name: str, at: Column, major: int) -> DataFrame:
    """Adds __<name>_n, the value of the head at a place (null if it isn't canonical or of that type), and __<name>_next behind it."""
    d = _step(d, __first=F.when(at < F.octet_length(_DATA), F.ascii(F.decode(_cut(at, 1), "ISO-8859-1")) - (major << 5)), __place=at)
    first = F.col("__first")
    d = _step(d, __size=F.when(first.between(0, 23), 0).when(first == 24, 1).when(first == 25, 2).when(first == 26, 4).when(first == 27, 8))
    raw = _cut(F.col("__place") + 1, F.col("__size"))
    # below 24 the head is the value; longer ones are read as digits, whose number also tells that all bytes are there
    d = _step(d, __digits=F.when(first >= 24, F.hex(raw)))
    d = _step(d, __long=F.when(F.octet_length("__digits") == 2 * F.col("__size"), F.conv("__digits", 16, 10).cast("decimal(20,0)")))
    least = F.when(first == 24, F.lit(24)).when(first == 25, F.lit(1 << 8)).when(first == 26, F.lit(1 << 16)).otherwise(F.lit(1 << 32))
    n = F.when(first.between(0, 23), first.cast("decimal(20,0)")).when(F.col("__long") >= least, F.col("__long"))
    out = _step(d, **{f"__{name}_n": n, f"__{name}_next": F.col("__place") + 1 + F.col("__size")})
    return out.drop("__first", "__place", "__size", "__digits", "__long")


def parsed(frames: DataFrame) -> DataFrame:
    """frames with the record's fields, all in the JVM; one that isn't canonical has them null and decode_error set."""
    kept = frames.columns
    size = F.octet_length(_DATA)

    def text(d: DataFrame, name: str, start: Column) -> DataFrame:
        """Adds __name_at, __name_n and __name_end of the text that starts at a place; the end is null if it isn't one."""
        d = _with_head(d, "h", start, 3)
        d = _step(d, **{f"__{name}_n": F.when(F.col("__h_n") <= size, F.col("__h_n").cast("int")), f"__{name}_at": F.col("__h_next")}).drop("__h_n", "__h_next")
        end = F.col(f"__{name}_at") + F.col(f"__{name}_n")
        return _step(d, **{f"__{name}_end": F.when(end <= size, end)})

    at = lambda name, plus=0: F.col(f"__{name}_end") + plus
    d = _with_head(frames, "prev", F.lit(2), 0).withColumnsRenamed({"__prev_n": "__id", "__prev_next": "__prev_end"})
    d = text(d, "ts", at("prev", 3 + HASH_BYTES + 1))
    d = _with_head(d, "mono", at("ts", 1), 0).withColumnsRenamed({"__mono_n": "__mono", "__mono_next": "__mono_end"})
    d = text(d, "actor", at("mono", 2 + SESSION_BYTES + 1))
    d = text(d, "event", at("actor", 1))
    # the end: 9, key_id, 10 and a version in one byte, or in two from 24 on
    short = _is(size - 2, b"\x0a") & (F.hex(_cut(size - 1, 1)) < "18")
    long = _is(size - 3, b"\x0a\x18") & (F.hex(_cut(size - 1, 1)) >= "18")
    d = _step(d, __tail_end=F.when(short, size - 2).when(long, size - 3) - 3 - HASH_BYTES)
    keys = [(F.lit(0), b"\xaa\x01"), (at("prev"), b"\x02\x58\x20"), (at("prev", 3 + HASH_BYTES), b"\x03"), (at("ts"), b"\x04"), (at("mono"), b"\x05\x50"), (at("mono", 2 + SESSION_BYTES), b"\x06"), (at("actor"), b"\x07"), (at("event"), b"\x08"), (at("tail"), b"\x09\x58\x20")]
    texts = {c: _cut(F.col(f"__{name}_at"), F.col(f"__{name}_n")).cast("string") for c, name in (("ts_wall", "ts"), ("actor", "actor"), ("event", "event"))}
    fine = F.col("__id").isNotNull() & F.col("__mono").isNotNull() & (at("tail") > at("event", 1)) & _cut(at("event", 1), 1).between(F.lit(b"\xa0"), F.lit(b"\xbb"))
    for place, what in keys:
        fine &= _is(place, what)
    for c in texts.values():
        fine &= F.is_valid_utf8(c)
    d = _step(d, __fine=F.coalesce(fine, F.lit(False)))
    fields = {"record_id": F.col("__id"), "prev_hash": _cut(at("prev", 3), HASH_BYTES), "ts_mono_delta": F.col("__mono"), "session_id": _cut(at("mono", 2), SESSION_BYTES), "payload": _cut(at("event", 1), at("tail") - at("event", 1)), "key_id": _cut(at("tail", 3), HASH_BYTES), "schema_version": F.conv(F.hex(_cut(size - 1, 1)), 16, 10).cast("int"), **texts}
    error = F.when(~F.col("__fine") & F.col(_DATA).isNotNull(), F.lit(BAD))
    return d.select(*kept, *[F.when(F.col("__fine"), fields[c]).alias(c) for c in FIELDS[:-1]], error.alias("decode_error"))
