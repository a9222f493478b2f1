"""The library's operators as named queries over the driver's tables, each with DuckDB SQL where SQL can express it.

Record inputs come from ``events`` (a log per user), ``orders`` (a log per customer) and ``conversations`` (a log per
conversation), as record_inputs() maps them. The key is a published test key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import FINALIZE_ACTOR, FINALIZE_EVENT, MAGIC
from ..functions import expressions as x
from ..functions.records import parsed
from ..keys import LocalKey
from ..operators import query as q
from ..operators.normative import normative_report
from ..operators.seal import SealConfig, record_inputs, seal, segments_of
from ..operators.verify import VerifyOptions, one_segment, report_json, verify, verify_files, violations
from ..sources.ranges import Wanted, build_index, find
from ..sources.segments import read_log, write_segments
from ..sources.shared import scratch, stored
from ..streaming.tail import seal_stream, tail, write_sealed

SECRET, SESSION = bytes(range(32)), bytes.fromhex("00112233445566778899aabbccddeeff")
KEY = LocalKey(SECRET)
SMALL = SealConfig(segment_bytes=4096)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", x.iso_millis(F.col("ts")).alias("ts_wall"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ms"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    e = e.withColumn("mono", F.col("ms") - F.min("ms").over(Window.partitionBy("user_id")))
    payload = x.cbor_text_map([("k", x.cbor_uint(F.col("k")))])
    return record_inputs(e, F.col("user_id"), F.col("event_id"), F.col("ts_wall"), F.col("mono"), F.concat(F.lit("user:"), "user_id"), F.concat(F.lit("event."), "event_type"), payload)


def order_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    o = o.withColumn("rid", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    payload = x.cbor_text_map([("cents", x.cbor_uint(F.col("cents")))])
    return record_inputs(o, F.col("o_custkey"), F.col("o_orderkey"), x.iso_millis(F.col("o_orderdate")), F.col("rid") * 1000, F.concat(F.lit("customer:"), "o_custkey"), F.concat(F.lit("order."), F.lower("o_orderstatus")), payload)


def conversation_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("rid", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    ts = F.concat(F.lit("2024-01-01T00:"), F.lpad(F.floor(F.col("rid") % 3600 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("rid") % 60).cast("string"), 2, "0"), F.lit(".000Z"))
    payload = x.cbor_text_map([("text", x.cbor_text(F.coalesce("text", F.lit(""))))])
    return record_inputs(c, F.col("conv_id"), F.col("turn"), ts, F.col("rid") * 1000, F.concat(F.lit("chat:"), "role"), F.lit("chat.turn"), payload)


def frames_of(sealed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, segments) of sealed rows, as if written to files and read back."""
    heads = segments_of(sealed).select("log_id", "segment_index", x.header_bytes(F.col("segment_index"), KEY.key_id, F.col("prev_final")).alias("header"))
    return sealed.select("log_id", "segment_index", "file_offset", "payload_bytes", "hmac", F.lit(False).alias("torn")), heads


def records(spark: SparkSession, sf_dir: str, config: SealConfig = SealConfig()) -> DataFrame:
    return parsed(frames_of(seal(event_inputs(spark, sf_dir), KEY, SESSION, config))[0])


def report(sealed: DataFrame, key=KEY, options: VerifyOptions = VerifyOptions(), change=lambda f: f) -> DataFrame:
    frames, segments = frames_of(stored(sealed, "sealed"))
    return verify(change(frames), segments, key, options)


def verdicts(r: DataFrame) -> DataFrame:
    return r.select("log_id", F.col("records_inspected"), "compact")


MARKED = "(file_offset + log_id::BIGINT) % 97 = 0"


def marked():
    """The frames that the tampering queries change."""
    return (F.col("file_offset") + F.col("log_id").cast("long")) % 97 == 0


def q_record_inputs(spark, sf):
    return event_inputs(spark, sf).select("log_id", "seq", "ts_wall", "ts_mono_delta", "actor", "event", x.hex_lower(F.col("payload")).alias("payload_hex"))


def q_hmac_payload(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", x.hex_lower(x.hmac_sha256(SECRET, F.encode(F.col("props"), "UTF-8"))).alias("hmac_hex"))


def q_header_crc(spark, sf):
    u = table(spark, sf, "events").select("user_id").distinct()
    body = x.header_body(F.col("user_id") % 9999, KEY.key_id, F.unhex(F.sha2(F.col("user_id").cast("string"), 256)))
    return u.select("user_id", F.crc32(body).alias("crc"), x.hex_lower(body).alias("body_hex"))


def q_cbor_record_bytes(spark, sf):
    i = event_inputs(spark, sf)
    tail = x.record_tail(F.col("ts_wall"), F.col("ts_mono_delta"), SESSION, F.col("actor"), F.col("event"), F.col("payload"), KEY.key_id, F.col("schema_version"))
    rid = F.row_number().over(Window.partitionBy("log_id").orderBy("seq")) - 1
    return i.select("log_id", "seq", x.hex_lower(x.record_bytes(rid, F.lit(bytes(32)), tail)).alias("record_hex"))


def q_ts_millis(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", x.iso_millis(F.col("o_orderdate")).alias("ts_wall"))
    return o.select("o_orderkey", x.ts_millis(F.col("ts_wall")).alias("ms"), x.bump_millisecond(F.col("ts_wall")).alias("bumped"))


def q_seal_chain_heads(spark, sf):
    # a user may have any share of the events: a streaming fold, in one segment without finalizing records
    sealed = seal(event_inputs(spark, sf), KEY, SESSION, SealConfig(finalize_on_rollover=False))
    heads = sealed.groupBy("log_id").agg(F.count(F.lit(1)).alias("records"), F.max_by("hmac", "record_id").alias("head"))
    return heads.select("log_id", "records", x.hex_lower(F.col("head")).alias("head_hex"))


def q_seal_chain_records(spark, sf):
    return q.chain_listing(records(spark, sf))


def q_verify_clean(spark, sf):
    r = report(seal(event_inputs(spark, sf), KEY, SESSION))
    return r.select("log_id", "segments_inspected", "records_inspected", "final_hmac_hex", "compact", "summary")


def q_verify_tampered_payload(spark, sf):
    flip = F.concat(F.substring("payload_bytes", F.lit(1), F.octet_length("payload_bytes") - 1), F.lit(b"\x02"))
    return verdicts(report(seal(event_inputs(spark, sf), KEY, SESSION), change=lambda f: f.withColumn("payload_bytes", F.when(marked(), flip).otherwise(F.col("payload_bytes")))))


def q_verify_tampered_hmac(spark, sf):
    flip = F.concat(F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring("hmac", 1, 1)), 16, 10).cast("int").bitwiseXOR(F.lit(255)).cast("long")), 2, "0")), F.substring("hmac", 2, 31))
    return verdicts(report(seal(event_inputs(spark, sf), KEY, SESSION), change=lambda f: f.withColumn("hmac", F.when(marked(), flip).otherwise(F.col("hmac")))))


def q_verify_missing_record(spark, sf):
    return verdicts(report(seal(event_inputs(spark, sf), KEY, SESSION), change=lambda f: f.filter(~marked())))


def q_verify_torn_tail(spark, sf):
    cut = lambda f: f.withColumn("torn", marked()).withColumn("payload_bytes", F.when(~marked(), F.col("payload_bytes"))).withColumn("hmac", F.when(~marked(), F.col("hmac")))
    return verdicts(report(seal(event_inputs(spark, sf), KEY, SESSION), change=cut))


def q_verify_wrong_key_id(spark, sf):
    return verdicts(report(seal(event_inputs(spark, sf), KEY, SESSION), key=LocalKey(SECRET, bytes(32))))


def q_verify_time_regression(spark, sf):
    return verdicts(report(seal(order_inputs(spark, sf), KEY, SESSION)))


def q_verify_time_inconsistency(spark, sf):
    i = event_inputs(spark, sf)
    i = i.withColumn("ts_mono_delta", (F.row_number().over(Window.partitionBy("log_id").orderBy("seq")) - 1).cast("long") * 1000)
    return verdicts(report(seal(i, KEY, SESSION), options=VerifyOptions(strict_time=True)))


def q_verify_long_payloads(spark, sf):
    return verdicts(report(seal(conversation_inputs(spark, sf), KEY, SESSION)))


def q_verify_rollover(spark, sf):
    r = report(seal(event_inputs(spark, sf), KEY, SESSION, SMALL))
    return r.select("log_id", "segments_inspected", "records_inspected", "compact")


def q_verify_forensic(spark, sf):
    flip = F.concat(F.substring("payload_bytes", F.lit(1), F.octet_length("payload_bytes") - 1), F.lit(b"\x02"))
    r = report(seal(event_inputs(spark, sf), KEY, SESSION, SMALL), options=VerifyOptions(forensic=True), change=lambda f: f.withColumn("payload_bytes", F.when(marked(), flip).otherwise(F.col("payload_bytes"))))
    return violations(r).drop("expected", "actual")


def q_verify_tampered_headers(spark, sf):
    """Each log's header but one in seven is damaged in one of the ways that verification tells apart."""
    frames, segments = frames_of(stored(seal(event_inputs(spark, sf), KEY, SESSION), "sealed"))
    h = F.col("header")
    put = lambda at, b: F.concat(F.substring(h, 1, at), F.lit(b), F.substring(h, at + len(b) + 1, 80))
    way = F.col("log_id").cast("long") % 7
    changed = F.when(way == 1, F.substring(h, 1, 40))
    for i, (at, b) in enumerate([(0, b"X"), (4, b"\2"), (72, b"\0\0\0\0\0"), (8, bytes(32)), (76, b"\1")]):
        sealed_again = put(at, b)
        if at in (4, 8):  # what the CRC covers is signed again
            body = F.substring(sealed_again, 1, 72)
            sealed_again = F.concat(body, x.le_bytes(F.crc32(body), 4), F.lit(bytes(4)))
        changed = changed.when(way == i + 2, sealed_again)
    return verdicts(verify(frames, stored(segments.withColumn("header", changed.otherwise(h)), "headers"), KEY))


def q_verify_resigned_records(spark, sf):
    """Marked records are changed and signed anew: bytes that don't decode, a wrong field, another key's id."""
    p, way = F.col("payload_bytes"), F.col("log_id").cast("long") % 3
    end = F.octet_length(p)
    other = F.concat(F.substring(p, F.lit(1), end - 34), F.lit(bytes(32)), F.substring(p, end - 1, F.lit(2)))
    changed = F.when(way == 0, F.concat(F.lit(b"\xff"), F.substring(p, F.lit(2), end))).when(way == 1, F.concat(F.substring(p, F.lit(1), end - 2), F.lit(b"\x0b\x01"))).otherwise(other)
    again = lambda f: f.withColumn("payload_bytes", F.when(marked(), changed).otherwise(p)).withColumn("hmac", F.when(marked(), x.hmac_sha256(SECRET, F.col("payload_bytes"))).otherwise(F.col("hmac")))
    return verdicts(report(seal(event_inputs(spark, sf), KEY, SESSION), change=again))


def q_verify_segment_filter(spark, sf):
    frames, segments = frames_of(stored(seal(event_inputs(spark, sf), KEY, SESSION, SMALL), "sealed"))
    return one_segment(frames.filter(~marked()), segments, KEY, 1).select("log_id", "segment_index", "kind", "record_id")


def q_report_json(spark, sf):
    return report_json(report(seal(event_inputs(spark, sf), KEY, SESSION), change=lambda f: f.filter(~marked())), KEY.key_id)


def q_segment_continuity(spark, sf):
    s = segments_of(seal(event_inputs(spark, sf), KEY, SESSION, SMALL))
    before = F.lag("final_hmac").over(Window.partitionBy("log_id").orderBy("segment_index"))
    return s.select("log_id", "segment_index", "records", (F.coalesce(before, F.lit(bytes(32))) == F.col("prev_final")).alias("continuous"))


def q_segment_summary(spark, sf):
    return q.segment_summary(records(spark, sf))


def q_show_range(spark, sf):
    return q.chain_listing(q.show(records(spark, sf), 5, 10))


def q_show_actor(spark, sf):
    return q.show(records(spark, sf), actor="er:1").select("log_id", F.col("record_id").cast("long").alias("record_id"), "actor", "event")


def q_show_event_glob(spark, sf):
    return q.show(records(spark, sf), event="event.?i*").select("log_id", F.col("record_id").cast("long").alias("record_id"), "event")


def q_show_combined(spark, sf):
    return q.show(records(spark, sf), 2, 30, "er:2", "*.s*").select("log_id", F.col("record_id").cast("long").alias("record_id"), "actor", "event", "ts_wall")


def q_show_json(spark, sf):
    return records(spark, sf).select("log_id", F.col("record_id").cast("long").alias("record_id"), q.as_json().alias("line"))


def q_show_text(spark, sf):
    return records(spark, sf).select("log_id", F.col("record_id").cast("long").alias("record_id"), q.as_text().alias("line"))


def q_head_per_log(spark, sf):
    return q.head(records(spark, sf), ["log_id"]).withColumn("segments", F.col("segments").cast("long")).withColumn("last_segment_index", F.col("last_segment_index").cast("long"))


def q_sample_head_tail(spark, sf):
    i = event_inputs(spark, sf).select("log_id", "seq", "ts_wall", "event")
    return q.sample(i, [F.col("seq")])


def q_first_and_last(spark, sf):
    r = q.first_and_last(records(spark, sf))
    return r.select("log_id", F.col("first.ts_wall").alias("first_ts"), F.col("first.event").alias("first_event"), F.col("last.ts_wall").alias("last_ts"), F.col("last.event").alias("last_event"))


def q_seek_record(spark, sf):
    return q.chain_listing(q.seek(records(spark, sf), 0, 7))


def q_file_roundtrip_verify(spark, sf):
    folder = scratch(spark, "logs")
    write_segments(seal(event_inputs(spark, sf), KEY, SESSION, SMALL), folder, KEY.key_id).write.format("noop").mode("overwrite").save()
    frames, segments = read_log(spark, folder)
    return verify(frames, segments, KEY).select("log_id", "compact")


def q_file_roundtrip_records(spark, sf):
    folder = scratch(spark, "logs")
    write_segments(seal(event_inputs(spark, sf), KEY, SESSION), folder, KEY.key_id).write.format("noop").mode("overwrite").save()
    return q.chain_listing(parsed(read_log(spark, folder)[0]))


def q_stream_tail(spark, sf):
    folder = scratch(spark, "logs")
    write_segments(seal(event_inputs(spark, sf), KEY, SESSION, SMALL), folder, KEY.key_id).write.format("noop").mode("overwrite").save()
    out, state = scratch(spark, "tail"), scratch(spark, "tail-state")
    stream = tail(spark, folder).select("log_id", "segment_index", "file_offset", "torn", F.octet_length("payload_bytes").alias("payload_len"))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def written(spark, sf, config: SealConfig = SealConfig(), change=lambda s: s) -> str:
    """The folder of the sealed events' files."""
    folder = scratch(spark, "logs")
    write_segments(change(seal(event_inputs(spark, sf), KEY, SESSION, config)), folder, KEY.key_id).write.format("noop").mode("overwrite").save()
    return folder


def q_verify_files(spark, sf):
    """One pass over indexed files, by ranges."""
    folder = written(spark, sf, SMALL)
    build_index(spark, folder, 1024)
    return verify_files(spark, folder, KEY, range_bytes=2048).select("log_id", "segments_inspected", "records_inspected", "compact")


def q_report_normative(spark, sf):
    flip = F.concat(F.substring("payload_bytes", F.lit(1), F.octet_length("payload_bytes") - 1), F.lit(b"\x02"))
    folder = written(spark, sf, change=lambda s: s.withColumn("payload_bytes", F.when(marked(), flip).otherwise(F.col("payload_bytes"))))
    return normative_report(spark, folder, verify_files(spark, folder, KEY), KEY.key_id)


def q_heads_of_files(spark, sf):
    return q.heads_of_files(spark, written(spark, sf)).withColumn("last_segment_index", F.col("last_segment_index").cast("long"))


def q_find_in_files(spark, sf):
    folder = written(spark, sf)
    build_index(spark, folder, 4096)
    found = find(spark, folder, Wanted(start=2, end=30, actor_contains="er:2", event_glob="*.s*"))
    return found.select("log_id", F.col("record_id").cast("long").alias("record_id"), "actor", "event", "ts_wall")


def q_seek_in_files(spark, sf):
    folder = written(spark, sf)
    build_index(spark, folder, 1024)
    return q.chain_listing(find(spark, folder, Wanted(segment_index=0, start=7, end=8)))


def q_stream_sealed_files(spark, sf):
    """Events that arrive in two parts, each sealed by a run of the same stream, as the files have them then."""
    i = event_inputs(spark, sf)
    arrived, folder, checkpoint = scratch(spark, "arrived"), scratch(spark, "logs"), scratch(spark, "seal-state")
    half = i.agg(F.floor(F.max("seq") / 2)).first()[0] or 0
    for part in (i.filter(F.col("seq") <= half), i.filter(F.col("seq") > half)):
        part.write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(i.schema).parquet(arrived)
        write_sealed(seal_stream(stream, KEY, SESSION), folder, KEY.key_id, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return q.chain_listing(parsed(read_log(spark, folder)[0]))


QUERIES = {f.__name__[2:]: f for f in list(globals().values()) if getattr(f, "__name__", "").startswith("q_")}


def _head(base: int, n: str) -> str:
    sizes = "".join(f" WHEN {n} < {1 << 8 * k} THEN printf('%02x%0{2 * k}x', {base + c}, ({n})::BIGINT)" for k, c in ((1, 24), (2, 25), (4, 26)))
    return f"unhex(CASE WHEN {n} < 24 THEN printf('%02x', ({base} + {n})::BIGINT){sizes} ELSE printf('%02x%016x', {base + 27}, ({n})::BIGINT) END)"


def _text(s: str) -> str:
    return f"{_head(96, f'strlen({s})')} || encode({s})"


def _hmac(data: str) -> str:
    block = SECRET.ljust(64, b"\0")
    inner, outer = (bytes(b ^ m for b in block).hex() for m in (0x36, 0x5C))
    return f"unhex(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {data}))))"


_ID = KEY.key_id.hex()
_START = _hmac(f"unhex('4f47415501000000{_ID}{'00' * 32}')")
_MS = "epoch_us({0}) // 1000"

#: Record inputs, their bytes, and the chain; log, rid (position), file_offset.
EVENTS = f"""
r0 AS (SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts_wall, {_MS.format('ts')} AS ms, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
r1 AS (SELECT user_id::VARCHAR AS log_id, event_id AS seq, (row_number() OVER l - 1)::BIGINT AS rid, ts_wall, ms, (ms - min(ms) OVER (PARTITION BY user_id))::BIGINT AS mono,
       'user:' || user_id AS actor, 'event.' || event_type AS event, unhex('a1616b') || {_head(0, 'k')} AS payload, k FROM r0 WINDOW l AS (PARTITION BY user_id ORDER BY event_id)),
r2 AS (SELECT *, unhex('aa01') || {_head(0, 'rid')} || unhex('025820') AS pre,
       unhex('03') || {_text('ts_wall')} || unhex('04') || {_head(0, 'mono')} || unhex('0550{SESSION.hex()}06') || {_text('actor')} || unhex('07') || {_text('event')} || unhex('08') || payload || unhex('095820{_ID}0a01') AS post FROM r1),
r AS (SELECT *, octet_length(pre) + 32 + octet_length(post) AS payload_len, (80 + coalesce(sum(octet_length(pre) + 72 + octet_length(post)) OVER (PARTITION BY log_id ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS file_offset FROM r2)"""
CHAIN = f"""WITH RECURSIVE {EVENTS},
c AS (SELECT log_id, rid, {_START} AS prev, {_hmac(f"pre || {_START} || post")} AS h FROM r WHERE rid = 0
      UNION ALL SELECT r.log_id, r.rid, c.h, {_hmac("r.pre || c.h || r.post")} FROM c JOIN r ON r.log_id = c.log_id AND r.rid = c.rid + 1),
a AS (SELECT r.*, lower(hex(c.prev)) AS prev_hex, lower(hex(c.h)) AS hmac_hex FROM r JOIN c USING (log_id, rid)),
n AS (SELECT log_id, count(*) AS n FROM r GROUP BY log_id)"""
_LISTING = "log_id, 0::INT AS segment_index, rid AS record_id, prev_hex AS prev_hash_hex, hmac_hex, payload_len::BIGINT AS payload_len"

_SESSION_HEX = SESSION.hex()


def _head_bytes(n: str) -> str:
    """The length of the head of a number."""
    return f"(CASE WHEN {n} < 24 THEN 1 WHEN {n} < 256 THEN 2 WHEN {n} < 65536 THEN 3 WHEN {n} < 4294967296 THEN 5 ELSE 9 END)"


def _closing(mono: str, count: str) -> str:
    """The length of a closing record's bytes behind prev_hash: fixed ones, the step after mono, and the count."""
    fixed = 27 + 1 + 18 + 1 + (1 + len(FINALIZE_ACTOR)) + 1 + (1 + len(FINALIZE_EVENT)) + 1 + (1 + 1 + 7 + 1 + 10 + 34) + 35 + 2
    return f"({fixed} + {_head_bytes(mono + ' + 1')} + {count})"


#: The walk of the writer with small segments, by lengths alone: at each record the segment, its offset, its number in the
#: segment, and where the closing record of the segment before lies (null unless one was written just before).
ROLLED = f"""WITH RECURSIVE {EVENTS},
z AS (SELECT log_id, rid, mono, octet_length(post) AS tail FROM r),
w AS (SELECT log_id, rid, mono, 0 AS seg, 80::BIGINT AS spot, 0::BIGINT AS num, 37 + {_head_bytes('0')} + tail AS len, NULL::BIGINT AS closed_at, NULL::BIGINT AS closed_len, NULL::BIGINT AS closed_num FROM z WHERE rid = 0
      UNION ALL
      SELECT log_id, rid, mono, CASE WHEN roll THEN seg + 1 ELSE seg END, CASE WHEN roll THEN 80 ELSE spot END, CASE WHEN roll THEN 0 ELSE num END,
             37 + CASE WHEN roll THEN 1 ELSE {_head_bytes('num')} END + tail, CASE WHEN roll THEN spot END, CASE WHEN roll THEN 37 + {_head_bytes('num')} + {_closing('before', _head_bytes('num'))} END, CASE WHEN roll THEN num END
      FROM (SELECT z.log_id, z.rid, z.mono, w.mono AS before, w.seg, w.spot + w.len + 40 AS spot, w.num + 1 AS num, z.tail,
                   w.spot + w.len + 40 + 86 + z.tail + 86 + {_closing('z.mono', '9')} > {SMALL.segment_bytes} AS roll
            FROM w JOIN z ON z.log_id = w.log_id AND z.rid = w.rid + 1)),
f AS (SELECT log_id, seg, num, spot, len FROM w UNION ALL SELECT log_id, seg - 1, closed_num, closed_at, closed_len FROM w WHERE closed_at IS NOT NULL)"""
#: CRC-32 of a list of bytes, by a table of 256 values made here.
CRC = """WITH RECURSIVE t AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) x(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tbl FROM t WHERE k = 8)"""


def _first_bad(bad: str, kind: str, seen: str = "b + 1", with_id: str = "|| 'r' || b") -> str:
    return f"""WITH {EVENTS}, n AS (SELECT log_id, count(*) AS n FROM r GROUP BY log_id), f AS ({bad})
SELECT log_id, CASE WHEN b IS NULL THEN n ELSE {seen} END::BIGINT AS records_inspected, CASE WHEN b IS NULL THEN 'Verified' ELSE '{kind}@s0' {with_id} END AS compact FROM n LEFT JOIN f USING (log_id)"""


_MARKED = f"SELECT log_id, min(rid) AS b FROM r WHERE {MARKED} GROUP BY log_id"

_HEADERS = "[NULL, 'HeaderCorrupt', 'HeaderCorrupt', 'UnknownVersion', 'HeaderCorrupt', 'KeyIdMismatch', 'HeaderCorrupt']"
#: The records that are left without the marked ones, and of each log the first whose chain is broken.
_KEPT = f"""k AS (SELECT log_id, rid, file_offset, hmac_hex, row_number() OVER w AS place, coalesce(lag(rid) OVER w, -1) AS before, coalesce(lag(hmac_hex) OVER w, lower(hex({_START}))) AS before_hex FROM a WHERE NOT ({MARKED}) WINDOW w AS (PARTITION BY log_id ORDER BY rid)),
v AS (SELECT log_id, rid AS b, place AS seen, file_offset AS spot, before_hex FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY rid) AS n FROM k WHERE before < rid - 1) WHERE n = 1),
l AS (SELECT log_id, count(*) AS n, arg_max(hmac_hex, rid) AS last_hex FROM k GROUP BY log_id)"""


def _json_log(seen: str, final: str) -> str:
    return f"""'"log":{{"log_dir":"' || log_id || '","key_id_hex":"{_ID}","segments_inspected":1,"records_inspected":' || {seen} || ',"first_segment_index":0,"last_segment_index":0,"final_hmac_hex":"' || {final} || '"}}}}'"""


def _sorted_log(seen: str, final: str) -> str:
    return f"""'{{"format_version":1,"log":{{"final_hmac_hex":"' || {final} || '","first_segment_index":0,"key_id_hex":"{_ID}","last_segment_index":0,"log_dir":"' || log_id || '","records_inspected":' || {seen} || ',"segments_inspected":1}},"verdict":'"""


ORACLE_SQL = {
    "verify_tampered_headers": f"""WITH {EVENTS} SELECT log_id, CASE WHEN log_id::BIGINT % 7 = 0 THEN count(*) ELSE 0 END AS records_inspected, CASE WHEN log_id::BIGINT % 7 = 0 THEN 'Verified' ELSE {_HEADERS}[log_id::BIGINT % 7 + 1] || '@s0' END AS compact FROM r GROUP BY log_id""",
    "verify_resigned_records": f"""WITH {EVENTS}, n AS (SELECT log_id, count(*) AS n FROM r GROUP BY log_id), f AS ({_MARKED})
SELECT log_id, CASE WHEN b IS NULL THEN n ELSE b + 1 END::BIGINT AS records_inspected, CASE WHEN b IS NULL THEN 'Verified' ELSE CASE WHEN log_id::BIGINT % 3 = 2 THEN 'KeyIdMismatch' ELSE 'RecordCorrupt' END || '@s0r' || b END AS compact FROM n LEFT JOIN f USING (log_id)""",
    "verify_forensic": f"""{ROLLED},
m AS (SELECT log_id, seg, num, spot, row_number() OVER (PARTITION BY log_id, seg ORDER BY spot) AS n FROM f WHERE (spot + log_id::BIGINT) % 97 = 0),
s AS (SELECT g.log_id, g.seg, m.num, m.spot FROM (SELECT DISTINCT log_id, seg FROM f) g LEFT JOIN m ON m.log_id = g.log_id AND m.seg = g.seg AND m.n = 1),
c AS (SELECT log_id, min(seg) FILTER (WHERE num IS NULL) AS c FROM s GROUP BY log_id),
d AS (SELECT s.log_id, min(seg) AS d FROM s JOIN c USING (log_id) WHERE num IS NOT NULL AND seg > c GROUP BY s.log_id),
x AS (SELECT s.*, CASE WHEN seg > d THEN 6 WHEN num IS NOT NULL THEN 8 END AS rank FROM s JOIN c USING (log_id) LEFT JOIN d USING (log_id))
SELECT log_id, seg::INT AS segment_index, rank::INT AS rank, CASE rank WHEN 8 THEN 'HmacMismatch' ELSE 'SegmentDiscontinuity' END AS kind, NULL::VARCHAR AS detail, CASE rank WHEN 8 THEN num END AS record_id, CASE rank WHEN 8 THEN spot ELSE 40 END AS byte_offset FROM x WHERE rank IS NOT NULL""",
    "report_json": f"""{CHAIN}, {_KEPT}
SELECT log_id, CASE WHEN b IS NULL THEN '{{"status":"ok","format_version":1,"segments_verified":1,' || {_json_log("n", "last_hex")}
  ELSE '{{"status":"tampered","format_version":1,"segments_verified":1,"violation":{{"kind":"ChainBreak","segment_index":0,"record_id":' || b || ',"byte_offset":' || spot || ',"message":"ChainBreak"}},"additional_violations":[],' || {_json_log("seen", "before_hex")} END AS json
FROM l LEFT JOIN v USING (log_id)""",
    "report_normative": f"""{CHAIN},
m AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY rid) AS nth FROM (SELECT a.*, lower(hex({_hmac("pre || unhex(prev_hex) || unhex(left(hex(post), 2 * octet_length(post) - 2) || '02')")})) AS made FROM a WHERE {MARKED})),
l AS (SELECT log_id, arg_max(hmac_hex, rid) AS last_hex FROM a GROUP BY log_id)
SELECT log_id, CASE WHEN rid IS NULL THEN {_sorted_log("n", "last_hex")} || '"Verified","violation":null}}'
  ELSE {_sorted_log("(rid + 1)", "prev_hex")} || '"Violation","violation":{{"evidence":{{"actual_hmac_hex":"' || hmac_hex || '","expected_hmac_hex":"' || made || '","payload_byte_offset":' || (file_offset + 4) || ',"payload_len":' || payload_len || '}},"kind":"HmacMismatch","location":{{"byte_offset":' || file_offset || ',"record_id":' || rid || ',"segment_index":0}},"message":"HMAC mismatch at s0r' || rid || ': expected ' || left(made, 6) || '..., got ' || left(hmac_hex, 6) || '..."}}}}' END AS report
FROM n JOIN l USING (log_id) LEFT JOIN (SELECT * FROM m WHERE nth = 1) USING (log_id)""",
    "verify_files": f"{ROLLED} SELECT log_id, (max(seg) + 1)::INT AS segments_inspected, count(*) AS records_inspected, 'Verified' AS compact FROM f GROUP BY log_id",
    "stream_sealed_files": f"{CHAIN} SELECT {_LISTING} FROM a",
    "seek_in_files": f"{CHAIN} SELECT {_LISTING} FROM a WHERE rid = 7",
    "record_inputs": f"WITH {EVENTS} SELECT log_id, seq, ts_wall, mono AS ts_mono_delta, actor, event, lower(hex(payload)) AS payload_hex FROM r",
    "hmac_payload": f"SELECT event_id, lower(hex({_hmac('encode(props)')})) AS hmac_hex FROM events",
    "cbor_record_bytes": f"WITH {EVENTS} SELECT log_id, seq, lower(hex(pre || unhex('{'00' * 32}') || post)) AS record_hex FROM r",
    "ts_millis": f"SELECT o_orderkey, ({_MS.format('o_orderdate')})::BIGINT AS ms, strftime(to_timestamp(({_MS.format('o_orderdate')} + 1) / 1000.0) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ') AS bumped FROM orders",
    "seal_chain_heads": f"{CHAIN} SELECT log_id, n AS records, hmac_hex AS head_hex FROM a JOIN n USING (log_id) WHERE rid = n - 1",
    "seal_chain_records": f"{CHAIN} SELECT {_LISTING} FROM a",
    "verify_clean": f"{CHAIN} SELECT log_id, 1::INT AS segments_inspected, n AS records_inspected, hmac_hex AS final_hmac_hex, 'Verified' AS compact, '✓ Verified · ' || n || ' events · chain head ' || left(hmac_hex, 8) AS summary FROM a JOIN n USING (log_id) WHERE rid = n - 1",
    "verify_tampered_payload": _first_bad(_MARKED, "HmacMismatch"),
    "verify_tampered_hmac": _first_bad(_MARKED, "HmacMismatch"),
    "verify_torn_tail": _first_bad(_MARKED, "RecordCorrupt", "b", ""),
    "verify_missing_record": f"""WITH {EVENTS}, k AS (SELECT log_id, rid, row_number() OVER w AS place, coalesce(lag(rid) OVER w, -1) AS before FROM r WHERE NOT ({MARKED}) WINDOW w AS (PARTITION BY log_id ORDER BY rid)),
f AS (SELECT log_id, count(*) AS n, min(rid) FILTER (WHERE before < rid - 1) AS b, min(place) FILTER (WHERE before < rid - 1) AS seen FROM k GROUP BY log_id)
SELECT log_id, coalesce(seen, n) AS records_inspected, CASE WHEN b IS NULL THEN 'Verified' ELSE 'ChainBreak@s0r' || b END AS compact FROM f""",
    "file_roundtrip_verify": f"WITH {EVENTS} SELECT DISTINCT log_id, 'Verified' AS compact FROM r",
    "file_roundtrip_records": f"{CHAIN} SELECT {_LISTING} FROM a",
    "verify_wrong_key_id": f"WITH {EVENTS} SELECT DISTINCT log_id, 0::BIGINT AS records_inspected, 'KeyIdMismatch@s0' AS compact FROM r",
    "verify_time_regression": f"""WITH o AS (SELECT o_custkey::VARCHAR AS log_id, {_MS.format('o_orderdate')} AS ms, row_number() OVER w - 1 AS rid, lag({_MS.format('o_orderdate')}) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
f AS (SELECT log_id, count(*) AS n, min(rid) FILTER (WHERE ms - before < -60000) AS b FROM o GROUP BY log_id)
SELECT log_id, (CASE WHEN b IS NULL THEN n ELSE b + 1 END)::BIGINT AS records_inspected, CASE WHEN b IS NULL THEN 'Verified' ELSE 'TimestampRegression@s0r' || b END AS compact FROM f""",
    "verify_time_inconsistency": _first_bad("SELECT log_id, min(rid) AS b FROM (SELECT log_id, rid, ms - lag(ms) OVER (PARTITION BY log_id ORDER BY rid) - 1000 AS d FROM r) WHERE abs(d) > 60000 GROUP BY log_id", "TimestampInconsistency"),
    "verify_long_payloads": "SELECT conv_id::VARCHAR AS log_id, count(*) AS records_inspected, 'Verified' AS compact FROM conversations GROUP BY conv_id",
    "segment_summary": f"{CHAIN} SELECT log_id, 0::INT AS segment_index, n AS record_count, lower(hex({_START})) AS chain_start_hex, hmac_hex AS final_hex FROM a JOIN n USING (log_id) WHERE rid = n - 1",
    "show_range": f"{CHAIN} SELECT {_LISTING} FROM a WHERE rid BETWEEN 5 AND 9",
    "show_actor": f"WITH {EVENTS} SELECT log_id, rid AS record_id, actor, event FROM r WHERE contains(actor, 'er:1')",
    "show_event_glob": f"WITH {EVENTS} SELECT log_id, rid AS record_id, event FROM r WHERE event GLOB 'event.?i*'",
    "show_combined": f"WITH {EVENTS} SELECT log_id, rid AS record_id, actor, event, ts_wall FROM r WHERE rid >= 2 AND rid < 30 AND contains(actor, 'er:2') AND event GLOB '*.s*'",
    "head_per_log": f"""{CHAIN} SELECT log_id, n AS record_count, 1::BIGINT AS segments, hmac_hex AS head_hmac_hex, 0::BIGINT AS last_segment_index, rid AS last_record_id, actor AS last_actor, event AS last_event, '{_ID}' AS key_id_hex, '{SESSION.hex()}' AS session_id_hex FROM a JOIN n USING (log_id) WHERE rid = n - 1""",
    "sample_head_tail": f"WITH {EVENTS} SELECT log_id, seq, ts_wall, event FROM (SELECT *, row_number() OVER (ORDER BY seq) AS a, row_number() OVER (ORDER BY seq DESC) AS b FROM r) WHERE a <= 50 OR b <= 50",
    "first_and_last": f"WITH {EVENTS} SELECT log_id, arg_min(ts_wall, rid) AS first_ts, arg_min(event, rid) AS first_event, arg_max(ts_wall, rid) AS last_ts, arg_max(event, rid) AS last_event FROM r GROUP BY log_id",
    "header_crc": f"""{CRC},
u AS (SELECT DISTINCT user_id FROM events),
b AS (SELECT user_id, '{MAGIC.hex()}0100' || printf('%02x%02x', ((user_id % 9999) % 256)::BIGINT, ((user_id % 9999) // 256)::BIGINT) || '{_ID}' || sha256(user_id::VARCHAR) AS body_hex FROM u)
SELECT user_id, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(body_hex, 2 * i + 1, 2))::BIGINT FOR i IN range(72)]), lambda c, x: xor(tbl[xor(c % 256, x) + 1], c // 256)), 4294967295) AS crc, body_hex FROM b, crc""",
    "verify_rollover": f"{ROLLED} SELECT log_id, (max(seg) + 1)::INT AS segments_inspected, count(*) AS records_inspected, 'Verified' AS compact FROM f GROUP BY log_id",
    "segment_continuity": f"{ROLLED} SELECT log_id, seg::INT AS segment_index, count(*) AS records, true AS continuous FROM f GROUP BY log_id, seg",
    "stream_tail": f"{ROLLED} SELECT log_id, seg::INT AS segment_index, spot AS file_offset, false AS torn, len::INT AS payload_len FROM f",
    "verify_segment_filter": f"""{ROLLED},
k AS (SELECT *, lag(num, 1, -1) OVER (PARTITION BY log_id, seg ORDER BY spot) AS before FROM (SELECT *, max(num) OVER (PARTITION BY log_id, seg) AS last FROM f) WHERE (spot + log_id::BIGINT) % 97 <> 0),
s AS (SELECT log_id, seg, min(num) FILTER (WHERE before < num - 1) AS broken, max(num) < max(last) AS cut FROM k GROUP BY log_id, seg),
x AS (SELECT a.log_id, a.broken, b.broken IS NULL AND b.cut AS apart FROM s a JOIN s b ON b.log_id = a.log_id AND b.seg = 0 WHERE a.seg = 1)
SELECT log_id, 1::INT AS segment_index, CASE WHEN apart THEN 'SegmentDiscontinuity' ELSE 'ChainBreak' END AS kind, CASE WHEN NOT apart THEN broken END AS record_id FROM x WHERE apart OR broken IS NOT NULL""",
    "show_json": f"""{CHAIN} SELECT log_id, rid AS record_id, '{{"segment_index":0,"record_id":' || rid || ',"ts_wall":"' || ts_wall || '","ts_mono_delta":' || mono || ',"session_id_hex":"{_SESSION_HEX}","actor":"' || actor || '","event":"' || event || '","payload":{{"k":' || k || '}},"key_id_hex":"{_ID}","schema_version":1,"prev_hash_hex":"' || prev_hex || '","hmac_hex":"' || hmac_hex || '"}}' AS line FROM a""",
    "show_text": f"""{CHAIN} SELECT log_id, rid AS record_id, '[s0r' || rid || '] ' || ts_wall || ' ' || actor || ' ' || event || chr(10) || '    payload: k=' || k || chr(10) || '    hmac:    ' || hmac_hex AS line FROM a""",
    "seek_record": f"{CHAIN} SELECT {_LISTING} FROM a WHERE rid = 7",
}
for _same, _as in (("heads_of_files", "head_per_log"), ("find_in_files", "show_combined")):
    ORACLE_SQL[_same] = ORACLE_SQL[_as]
