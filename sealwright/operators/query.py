"""Reading records: filters, projections, heads, summaries and samples of parsed frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SAMPLE_ROWS
from ..functions import cbor
from ..functions.expressions import glob, hex_lower

ORDER = ("segment_index", "file_offset")


def show(records: DataFrame, start: int | None = None, end: int | None = None, actor: str | None = None, event: str | None = None) -> DataFrame:
    """Records with start <= record_id < end (in each segment), an actor that contains the text, an event that matches the glob."""
    if start is not None:
        records = records.filter(F.col("record_id") >= start)
    if end is not None:
        records = records.filter(F.col("record_id") < end)
    if actor is not None:
        records = records.filter(F.contains("actor", F.lit(actor)))
    return records if event is None else records.filter(glob(F.col("event"), event))


def payload_json(payload: Column) -> Column:
    """Canonical payload bytes as JSON with keys in order; bytes are 0x-text. Null where they aren't a payload."""
    import json

    @F.pandas_udf("string")
    def text(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda data: None if data is None else json.dumps(cbor.printable(cbor.decode(data)), ensure_ascii=False, separators=(",", ":"), sort_keys=True))

    return text(payload)


def as_json() -> Column:
    """A record as one JSON line. Only the payload, whose shape is open, passes through Python."""
    head = F.to_json(F.struct("segment_index", F.col("record_id").cast("long").alias("record_id"), "ts_wall", F.col("ts_mono_delta").cast("decimal(20,0)").alias("ts_mono_delta"), hex_lower(F.col("session_id")).alias("session_id_hex"), "actor", "event"))
    tail = F.to_json(F.struct(hex_lower(F.col("key_id")).alias("key_id_hex"), "schema_version", hex_lower(F.col("prev_hash")).alias("prev_hash_hex"), hex_lower(F.col("hmac")).alias("hmac_hex")))
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"payload":'), payload_json(F.col("payload")), F.lit(","), F.substring(tail, F.lit(2), F.length(tail)))


def inlined(payload: Column, bytes_as: str | None = None) -> Column:
    """Canonical payload bytes as k=v, ..., in the order of the keys; maps and lists collapse. Bytes are 0x-text or ``bytes_as``."""

    @F.pandas_udf("string")
    def text(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda data: None if data is None else cbor.inline(cbor.decode(data), bytes_as))

    return text(payload)


def as_text(bytes_as: str | None = None) -> Column:
    """A record as lines of text; an empty payload has none."""
    place = F.format_string("[s%dr%d] %s %s %s", F.col("segment_index"), F.col("record_id").cast("long"), F.col("ts_wall"), F.col("actor"), F.col("event"))
    shown = inlined(F.col("payload"), bytes_as)
    return F.concat(place, F.when(shown != "", F.concat(F.lit("\n    payload: "), shown)).otherwise(""), F.lit("\n    hmac:    "), hex_lower(F.col("hmac")))


def head(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and the last record, of all records or of each log; without verification, so no key is needed."""
    last = F.max_by(F.struct("segment_index", F.col("record_id").cast("long").alias("record_id"), "actor", "event", hex_lower(F.col("hmac")).alias("hmac"), hex_lower(F.col("key_id")).alias("key_id"), hex_lower(F.col("session_id")).alias("session_id")), F.struct(*([c for c in ("log_id",) if not by]), *ORDER))
    out = records.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("record_count"), F.countDistinct("segment_index").alias("segments"), last.alias("last"))
    return out.select(*(by or []), "record_count", "segments", F.col("last.hmac").alias("head_hmac_hex"), F.col("last.segment_index").alias("last_segment_index"), F.col("last.record_id").alias("last_record_id"), F.col("last.actor").alias("last_actor"), F.col("last.event").alias("last_event"), F.col("last.key_id").alias("key_id_hex"), F.col("last.session_id").alias("session_id_hex"))


def heads_of_files(spark, folder: str) -> DataFrame:
    """head() of each log from its files: a task reads a segment's last frame, whose record id tells the segment's count."""
    from ..functions.records import parsed
    from ..sources.ranges import segment_files, tail_frames

    tails = tail_frames(segment_files(spark, folder)).filter("hmac is not null")
    logs = tails.groupBy("log_id").agg(F.sum("records").cast("long").alias("record_count"), F.count(F.lit(1)).alias("segments"), F.max_by(F.struct("segment_index", "file_offset", "payload_bytes", "hmac"), "segment_index").alias("tail"))
    last = head(parsed(logs.select("log_id", "tail.*")), ["log_id"]).drop("record_count", "segments")
    return logs.select("log_id", "record_count", "segments").join(last, "log_id")


def segment_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("log_id", "segment_index").agg(F.count(F.lit(1)).alias("record_count"), hex_lower(F.min_by("prev_hash", "file_offset")).alias("chain_start_hex"), hex_lower(F.max_by("hmac", "file_offset")).alias("final_hex"))


def chain_listing(records: DataFrame) -> DataFrame:
    return records.select("log_id", "segment_index", F.col("record_id").cast("long").alias("record_id"), hex_lower(F.col("prev_hash")).alias("prev_hash_hex"), hex_lower(F.col("hmac")).alias("hmac_hex"), F.octet_length("payload_bytes").cast("long").alias("payload_len"))


def sample(records: DataFrame, order: list[Column], n: int = SAMPLE_ROWS) -> DataFrame:
    """The first and the last n records in a total order; all of them where there are no more than 2 n. Each side is a top-k.

    Sides of more than 2 n records don't meet, so equal records needn't be told apart.
    """
    if len(records.select(F.lit(1)).take(2 * n + 1)) <= 2 * n:
        return records
    first = records.orderBy(*[c.asc() for c in order]).limit(n)
    return first.unionByName(records.orderBy(*[c.desc() for c in order]).limit(n))


def first_and_last(records: DataFrame) -> DataFrame:
    place = F.struct(*ORDER)
    return records.groupBy("log_id").agg(F.min_by(F.struct("ts_wall", "event"), place).alias("first"), F.max_by(F.struct("ts_wall", "event"), place).alias("last"))


def seek(records: DataFrame, segment_index: int, record_id: int) -> DataFrame:
    return records.filter((F.col("segment_index") == segment_index) & (F.col("record_id") == record_id))
