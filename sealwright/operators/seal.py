"""Sealing: records in order become chained, framed records in segments.

The part of a record's bytes behind prev_hash is built in the JVM; only the chain itself, which is sequential, runs in
Python: one pass over rows sorted by log and order, holding one record at a time, so a log of any length needs no more
memory than a short one. Logs are independent and are what sealing is spread over.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_SEGMENT_BYTES, FINALIZE_ACTOR, FINALIZE_EVENT, FORMAT_VERSION, FRAME_OVERHEAD, HEADER_BYTES, MAGIC, MAX_SEGMENT_INDEX
from ..errors import SealError
from ..functions import cbor
from ..functions.expressions import record_tail

SEALED = "log_id string, segment_index int, record_id long, file_offset long, prev_final binary, prev_hash binary, hmac binary, payload_bytes binary"


#: Where a chain stands: Chain.state().
STATE = "segment int, prev_final binary, offset long, count long, last binary, ts string, mono long"


@dataclass(frozen=True)
class SealConfig:
    segment_bytes: int = DEFAULT_SEGMENT_BYTES
    finalize_on_rollover: bool = True


def record_inputs(df: DataFrame, log_id: Column, seq: Column, ts_wall: Column, ts_mono: Column, actor: Column, event: Column, payload: Column, version: Column | None = None) -> DataFrame:
    """A table of record inputs: log_id, seq (unique in a log; the order to seal in), the six fields; payload is canonical CBOR."""
    return df.select(log_id.cast("string").alias("log_id"), seq.cast("long").alias("seq"), ts_wall.alias("ts_wall"), ts_mono.cast("long").alias("ts_mono_delta"), actor.alias("actor"), event.alias("event"), payload.alias("payload"), (version if version is not None else F.lit(1)).cast("long").alias("schema_version"))


def checked(inputs: DataFrame) -> DataFrame:
    """The inputs; raises where a time isn't 24 bytes that end with Z, or is no real time, or a field is null or negative."""
    real = F.try_to_timestamp("ts_wall", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).isNotNull()
    good = real & (F.octet_length("ts_wall") == 24) & (F.col("ts_mono_delta") >= 0) & F.col("schema_version").between(0, 255)
    for c in ("log_id", "seq", "actor", "event", "payload"):
        good &= F.col(c).isNotNull()
    fine = F.when(F.coalesce(good, F.lit(False)), F.col("ts_wall")).otherwise(F.raise_error(F.concat(F.lit("not a record input: "), F.to_json(F.struct("log_id", "seq", "ts_wall")))))
    return inputs.withColumn("ts_wall", fine)


def bumped(ts_wall: str) -> str:
    t = datetime.datetime.strptime(ts_wall, "%Y-%m-%dT%H:%M:%S.%fZ") + datetime.timedelta(milliseconds=1)
    return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"


class Chain:
    """One log's writer state: where it stands, and the step that appends a record."""

    def __init__(self, log_id: str, key, session: bytes, config: SealConfig, segment: int = 0, prev_final: bytes = bytes(32), offset: int = HEADER_BYTES, count: int = 0, last: bytes | None = None, last_times: tuple = ("", 0)):
        self.log_id, self.key, self.session, self.config = log_id, key, session, config
        self.segment, self.prev_final, self.offset, self.count, self.last_times = segment, prev_final, offset, count, last_times
        start = key.sign(MAGIC + FORMAT_VERSION.to_bytes(2, "little") + segment.to_bytes(2, "little") + key.key_id + prev_final) if segment == 0 else prev_final
        self.last = last if last is not None else start
        # the length of a closing record's tail, but for the head of its mono
        self.closing = len(self._finalize_tail(("1970-01-01T00:00:00.000Z", -1), (1 << 64) - 1, bytes(32))) - 1

    def state(self) -> tuple:
        """What of() needs to go on: STATE's fields."""
        return (self.segment, self.prev_final, self.offset, self.count, self.last, *self.last_times)

    @classmethod
    def of(cls, log_id: str, key, session: bytes, config: SealConfig, state: tuple | None) -> Chain:
        if state is None:
            return cls(log_id, key, session, config)
        segment, prev_final, offset, count, last, ts, mono = state
        return cls(log_id, key, session, config, int(segment), bytes(prev_final), int(offset), int(count), bytes(last), (ts, int(mono)))

    def _put(self, tail: bytes) -> tuple:
        payload = b"\xaa\x01" + cbor.head(0, self.count) + b"\x02\x58\x20" + self.last + tail
        signed = self.key.sign(payload)
        row = (self.log_id, self.segment, self.count, self.offset, self.prev_final, self.last, signed, payload)
        self.last, self.count, self.offset = signed, self.count + 1, self.offset + len(payload) + FRAME_OVERHEAD
        return row

    def _finalize_tail(self, times: tuple, records: int, final: bytes) -> bytes:
        fields = {4: times[1] + 1, 5: self.session, 6: FINALIZE_ACTOR, 7: FINALIZE_EVENT, 8: {"records": records, "final_hash": final}, 9: self.key.key_id, 10: 1}
        return b"\x03" + cbor.encode(bumped(times[0])) + b"".join(bytes([k]) + cbor.encode(v) for k, v in fields.items())

    def append(self, tail: bytes, times: tuple) -> Iterator[tuple]:
        """The rows of a record, led by a segment.finalized record where the segment would grow beyond its limit."""
        worst = 1 + 1 + 9 + 1 + 2 + 32 + FRAME_OVERHEAD
        finalize = worst + self.closing + len(cbor.head(0, times[1] + 1))
        if self.config.finalize_on_rollover and self.count and self.offset + worst + len(tail) + finalize > self.config.segment_bytes:
            if self.segment >= MAX_SEGMENT_INDEX:
                raise SealError(f"log {self.log_id} has no segment names left")
            yield self._put(self._finalize_tail(self.last_times, self.count, self.last))
            self.segment, self.prev_final, self.offset, self.count = self.segment + 1, self.last, HEADER_BYTES, 0
        yield self._put(tail)
        self.last_times = times


def seal(inputs: DataFrame, key, session: bytes, config: SealConfig = SealConfig(), resume: DataFrame | None = None) -> DataFrame:
    """SEALED rows of the inputs (record_inputs()), one chain a log; raises on a repeated (log_id, seq).

    Retried tasks give equal bytes: no clock or random number is used. ``resume`` has log_id and STATE's fields of logs that
    go on (operators.recover); a log's state comes to its task before its rows.
    """
    tail = record_tail(F.col("ts_wall"), F.col("ts_mono_delta"), session, F.col("actor"), F.col("event"), F.col("payload"), key.key_id, F.col("schema_version"))
    rows = checked(inputs).select("log_id", "seq", "ts_wall", "ts_mono_delta", tail.alias("tail"))
    fields = [x.strip().split()[0] for x in STATE.split(",")]
    resumed = resume is not None
    if resumed:
        states = resume.filter("last is not null").select("log_id", F.struct(*fields).alias("state"))
        rows = rows.unionByName(states, allowMissingColumns=True)
    order = ["log_id", *([F.col("state").isNull()] if resumed else []), "seq"]
    ordered = rows.repartition("log_id").sortWithinPartitions(*order)

    def fold(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        names, chain, before, found = [x.split()[0] for x in SEALED.split(", ")], None, None, {}
        for batch in batches:
            out: list[tuple] = []
            states = batch.column("state").to_pylist() if resumed else [None] * batch.num_rows
            for log_id, seq, ts, mono, t, state in zip(*(batch.column(c).to_pylist() for c in ("log_id", "seq", "ts_wall", "ts_mono_delta", "tail")), states):
                if state is not None:
                    found = {log_id: tuple(state[f] for f in fields)}
                    continue
                if (log_id, seq) == before:
                    raise SealError(f"log {log_id} has two records {seq}")
                if before is None or before[0] != log_id:
                    chain = Chain.of(log_id, key, session, config, found.get(log_id))
                before = (log_id, seq)
                out.extend(chain.append(t, (ts, mono)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return ordered.mapInArrow(fold, SEALED)


def seal_native(inputs: DataFrame, secret: bytes, key_id: bytes, session: bytes) -> DataFrame:
    """log_id, records, head: the chain of each log folded in the JVM, for short logs of one segment and public keys only.

    A log's tails are gathered in one array, so logs must be short; seal() has no such limit.
    """
    from ..functions.expressions import header_body, hmac_sha256, record_bytes

    tail = record_tail(F.col("ts_wall"), F.col("ts_mono_delta"), session, F.col("actor"), F.col("event"), F.col("payload"), key_id, F.col("schema_version"))
    logs = checked(inputs).select("log_id", "seq", tail.alias("tail")).groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("seq", "tail"))).alias("rows"))
    start = hmac_sha256(secret, header_body(F.lit(0), key_id, F.lit(bytes(32))))
    state = F.struct(F.lit(0).cast("long").alias("n"), start.alias("last"))
    step = lambda acc, r: F.struct((acc["n"] + 1).alias("n"), hmac_sha256(secret, record_bytes(acc["n"], acc["last"], r["tail"])).alias("last"))
    return logs.select("log_id", F.size("rows").cast("long").alias("records"), F.aggregate("rows", state, step)["last"].alias("head"))


def segments_of(sealed: DataFrame) -> DataFrame:
    """log_id, segment_index, prev_final, records, final_hmac of sealed rows."""
    return sealed.groupBy("log_id", "segment_index").agg(F.first("prev_final").alias("prev_final"), F.count(F.lit(1)).alias("records"), F.max_by("hmac", "file_offset").alias("final_hmac"))
