"""Verification: every check of a log as columns over frames, and the verdict as aggregates.

Writing a chain is a fold, but checking it isn't: a record names its predecessor's HMAC, so one lag() inside a segment
and one comparison per record do. Checks that reach across segments run on one row a segment. A record's or segment's
failure is the one with the smallest (position, rank), which is where an early-exit walk would stop.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CHECKS, FORMAT_VERSION, HEADER_BODY, HEADER_BYTES, MAGIC, TIME_SLACK_MS
from ..errors import BY_KIND, VerificationError
from ..functions import cbor
from ..functions.expressions import compact_verdict, hex_lower, summary_line, ts_millis

DECODED = "record_id decimal(20,0), prev_hash binary, ts_wall string, ts_mono_delta decimal(20,0), session_id binary, actor string, event string, payload binary, payload_json string, key_id binary, schema_version int, decode_error string"
VIOLATIONS = "log_id string, segment_index int, rank int, kind string, detail string, record_id long, byte_offset long, expected string, actual string"


def decoded(frames: DataFrame) -> DataFrame:
    """frames with the record's fields; a record that doesn't decode has them null and decode_error set."""
    import json
    from decimal import Decimal

    @F.pandas_udf(DECODED)
    def fields(payloads: pd.Series) -> pd.DataFrame:
        rows = []
        for data in payloads:
            v, error = cbor.decode_record(data) if data is not None else (None, None)
            if v is None:
                rows.append((None,) * 11 + (error,))
            else:
                text = json.dumps(cbor.printable(v[8]), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
                rows.append((Decimal(v[1]), v[2], v[3], Decimal(v[4]), v[5], v[6], v[7], cbor.encode(v[8]), text, v[9], v[10], None))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in DECODED.replace("(20,0)", "").split(", ")])

    return frames.select("*", fields("payload_bytes").alias("__f")).select("*", "__f.*").drop("__f")


INSPECTED = "record_id decimal(20,0), prev_hash binary, ts_wall string, ts_mono_delta decimal(20,0), session_id binary, event string, key_id binary, decode_error string, expected_hmac binary"


def inspected(frames: DataFrame, key) -> DataFrame:
    """frames without their bytes, but with what verification asks of a record: some fields, and the HMAC it should have.

    Bytes cross to Python once, where they are read, and no shuffle carries them.
    """
    from decimal import Decimal

    @F.pandas_udf(INSPECTED)
    def fields(payloads: pd.Series) -> pd.DataFrame:
        rows = []
        for data in payloads:
            v, error = cbor.decode_record(data) if data is not None else (None, None)
            signed = None if data is None else key.sign(data)
            rows.append((None,) * 7 + (error, signed) if v is None else (Decimal(v[1]), v[2], v[3], Decimal(v[4]), v[5], v[7], v[9], None, signed))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in INSPECTED.replace("(20,0)", "").split(", ")])

    kept = [c for c in frames.columns if c != "payload_bytes"]
    return frames.select(*kept, fields("payload_bytes").alias("__f")).select(*kept, "__f.*")


def signed(key, data: Column) -> Column:
    """The key's HMAC of the bytes; the key stays in the function's closure and out of the plan."""

    @F.pandas_udf("binary")
    def sign(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda x: None if x is None else key.sign(x))

    return sign(data)


def header_checks(segments: DataFrame, key) -> DataFrame:
    """segments (log_id, segment_index, header) with prev_final, chain_start and rank: the first failing header check, if any."""
    h = F.col("header")
    part = lambda at, n: F.substring(h, at + 1, n)
    rank = (
        F.when(F.octet_length(h) < HEADER_BYTES, 0)
        .when(part(0, 4) != F.lit(MAGIC), 1)
        .when(part(4, 2) != F.lit(FORMAT_VERSION.to_bytes(2, "little")), 2)
        .when(F.conv(F.concat(*[F.hex(part(i, 1)) for i in (75, 74, 73, 72)]), 16, 10).cast("long") != F.crc32(part(0, HEADER_BODY)), 3)
        .when(part(8, 32) != F.lit(key.key_id), 4)
        .when(part(76, 4) != F.lit(bytes(4)), 5)
    )
    out = segments.withColumn("prev_final", part(40, 32)).withColumn("rank", rank)
    return out.withColumn("chain_start", F.when(F.col("segment_index") == 0, signed(key, part(0, HEADER_BODY))).otherwise(F.col("prev_final")))


@dataclass(frozen=True)
class VerifyOptions:
    forensic: bool = False
    #: Also report clocks that drift apart within a session, which is specified but not produced by default.
    strict_time: bool = False
    #: After a failed segment the next is compared with the last clean one, and so is reported too; False skips that.
    cascade: bool = True


def record_checks(frames: DataFrame, segments: DataFrame, key, options: VerifyOptions = VerifyOptions()) -> DataFrame:
    """frames (inspected()) with pos, rank (of the first failing record check) and ts_ms; checks across segments are left out."""
    f = frames.join(segments.filter("rank is null").select("log_id", "segment_index", "chain_start"), ["log_id", "segment_index"])
    w = Window.partitionBy("log_id", "segment_index").orderBy("file_offset")
    f = f.withColumn("pos", F.row_number().over(w) - 1)
    f = f.withColumn("prev_stored", F.coalesce(F.lag("hmac").over(w), F.col("chain_start"))).withColumn("ts_ms", ts_millis(F.col("ts_wall")))
    step = F.col("ts_ms") - F.lag("ts_ms").over(w)
    mono = F.col("ts_mono_delta") - F.lag("ts_mono_delta").over(w)
    same = F.col("session_id") == F.lag("session_id").over(w)
    rank = (
        F.when(F.col("torn"), 7)
        .when(F.col("hmac") != F.col("expected_hmac"), 8)
        .when(F.col("decode_error").startswith("schema"), 10)
        .when(F.col("decode_error").isNotNull(), 9)
        .when(F.col("prev_hash") != F.col("prev_stored"), 11)
        .when(F.col("key_id") != F.lit(key.key_id), 12)
        .when(step < -TIME_SLACK_MS, 13)
    )
    if options.strict_time:
        rank = rank.when(same & (F.abs(step - mono) > TIME_SLACK_MS), 14)
    return f.withColumn("rank", rank)


def segment_states(checked: DataFrame, segments: DataFrame) -> DataFrame:
    """A row a segment: its header's and its records' first failure, and what the walk over segments needs."""
    bad = F.when(F.col("rank").isNotNull(), F.struct("pos", "rank", "file_offset", F.col("record_id").cast("long").alias("record_id"), hex_lower(F.col("expected_hmac")).alias("recomputed"), hex_lower(F.col("hmac")).alias("stored"), hex_lower(F.col("prev_stored")).alias("prev_stored"), hex_lower(F.col("prev_hash")).alias("prev_hash"), hex_lower(F.col("key_id")).alias("key_id"), "ts_wall", "decode_error"))
    keys = ["log_id", "segment_index"]
    first_bad = F.min(bad).over(Window.partitionBy(*keys))
    c = checked.withColumn("fail", first_bad)
    time = F.struct("ts_ms", F.col("ts_mono_delta").alias("mono"), "session_id")
    accepted = F.col("fail").isNull() | (F.col("pos") < F.col("fail.pos"))
    state = c.groupBy(*keys).agg(
        F.first("fail").alias("fail"),
        F.count(F.when(~F.col("torn") & (F.col("fail").isNull() | (F.col("pos") <= F.col("fail.pos"))), 1)).alias("seen"),
        F.max_by("hmac", "pos").alias("last_hmac"),
        F.max_by("hmac", F.when(accepted, F.col("pos"))).alias("accepted_hmac"),
        F.min_by(time, "pos").alias("first_time"),
        F.max_by(time, F.when(accepted, F.col("pos"))).alias("last_time"),
    )
    return segments.select(*keys, "prev_final", "chain_start", F.col("rank").alias("header_rank")).join(state, keys, "left")


def known(time: dict | None) -> dict | None:
    """A record's time, if there was a record that decoded."""
    return time if time and time["ts_ms"] is not None else None


def time_rank(before: dict | None, now: dict | None, options: VerifyOptions) -> int | None:
    """13 if the clock went back from a record to the next, 14 if it drifted within a session and that is asked for."""
    if before is None or now is None:
        return None
    step = now["ts_ms"] - before["ts_ms"]
    if step < -TIME_SLACK_MS:
        return 13
    same = now["session_id"] == before["session_id"]
    return 14 if options.strict_time and same and abs(step - int(now["mono"] - before["mono"])) > TIME_SLACK_MS else None


def _walk(key_id: bytes, options: VerifyOptions, join=None):
    """The ordered walk over the segments of each log (at most 10,000 rows a log), as a mapInArrow function.

    ``join`` makes one row a segment of rows of its ranges.
    """
    offsets = {2: 4, 3: 72, 4: 8, 5: 76}

    def walk(rows: list[dict]) -> dict:
        out, prior_final, prior, seen, last, indices = [], None, None, 0, None, []
        for r in rows if join is None else join(rows):
            indices.append(r["segment_index"])
            fail, violation = r["fail"], None
            if r["header_rank"] is not None:
                violation = (r["header_rank"], None, offsets.get(r["header_rank"], 0), None, None)
            elif prior_final is not None and r["prev_final"] != prior_final:
                violation = (6, None, 40, prior_final.hex(), r["prev_final"].hex())
            else:
                rank = time_rank(prior, known(r["first_time"]), options)
                if rank and (fail is None or fail["pos"] > 0 or fail["rank"] > rank):
                    seen += 1
                    violation = (rank, 0, HEADER_BYTES, None, None)
                else:
                    seen += r["seen"] or 0
                    prior = known(r["last_time"]) or prior
                    last = r["accepted_hmac"] or last or r["chain_start"]
                    if fail is not None:
                        k = fail["rank"]
                        record_id = None if k == 7 else fail["pos"] if k in (8, 9, 10) else fail["record_id"]
                        evidence = {8: (fail["recomputed"], fail["stored"]), 11: (fail["prev_stored"], fail["prev_hash"]), 12: (key_id.hex(), fail["key_id"])}
                        violation = (k, record_id, fail["file_offset"], *evidence.get(k, (None, fail["decode_error"])))
                if violation is None:
                    prior_final = r["last_hmac"] or r["chain_start"]
                elif not options.cascade:
                    prior_final = None
            if violation:
                out.append(dict(zip(NAMES, (r["log_id"], r["segment_index"], violation[0], *CHECKS[violation[0]], *violation[1:]))))
                if not options.forensic:
                    break
        return {"log_id": rows[0]["log_id"], "segments_inspected": len(indices), "records_inspected": seen, "first_segment_index": indices[0], "last_segment_index": indices[-1], "final_hmac_hex": last.hex() if last else None, "violations": out}

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        one = pa.struct([(n, kinds[t]) for n, t in (x.split() for x in VIOLATIONS.split(", "))])
        schema = pa.schema([*((n, kinds[t]) for n, t in (x.split() for x in COUNTERS.split(", "))), ("violations", pa.list_(one))])
        held: list[dict] = []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held and held[0]["log_id"] != r["log_id"]:
                    out.append(walk(held))
                    held = []
                held.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([walk(held)], schema=schema)

    return run


NAMES = [x.split()[0] for x in VIOLATIONS.split(", ")]
COUNTERS = "log_id string, segments_inspected int, records_inspected long, first_segment_index int, last_segment_index int, final_hmac_hex string"
REPORT = f"{COUNTERS}, violations array<struct<{VIOLATIONS.replace(' ', ':').replace(',:', ',')}>>"


def verify(frames: DataFrame, segments: DataFrame, key, options: VerifyOptions = VerifyOptions()) -> DataFrame:
    """A report row a log: counters, final_hmac_hex (of the last record that verified), key_id_hex, verdict, compact, violations.

    frames: log_id, segment_index, file_offset, payload_bytes, hmac, torn. segments: log_id, segment_index, header.
    """
    heads = header_checks(segments, key)
    states = segment_states(record_checks(inspected(frames, key), heads, key, options), heads)
    states = states.repartition("log_id").sortWithinPartitions("log_id", "segment_index")
    return _reported(states.mapInArrow(_walk(key.key_id, options), REPORT), key)


def _reported(report: DataFrame, key) -> DataFrame:
    first = F.get("violations", F.lit(0))
    report = report.withColumn("verdict", F.when(F.size("violations") == 0, "Verified").otherwise("Violation"))
    report = report.withColumn("compact", compact_verdict(first["kind"], first["segment_index"], first["record_id"]))
    report = report.withColumn("key_id_hex", F.lit(key.key_id.hex()))
    return report.withColumn("summary", summary_line(F.size("violations") == 0, F.col("records_inspected"), F.col("final_hmac_hex"), first["kind"], first["segment_index"], first["record_id"]))


def verify_files(spark, folder: str, key, options: VerifyOptions = VerifyOptions(), range_bytes: int = 32 << 20) -> DataFrame:
    """verify() of a log's or a store's files in one pass where they are read.

    A task walks a range of a segment and gives one row: its first failure, and the HMACs and times at its ends; records
    aren't shuffled. A segment is divided where its index (sources.ranges) says that frames start; a range begins with a look
    at the frame before it. Ranges must meet: where they don't, the index is wrong and the rest of the segment is walked as
    it lies. So the verdict is the same with any index, or none.
    """
    from ..sources.ranges import _spread, ranges
    from .walk import STATES, check_ranges, joined

    found = ranges(spark, folder)
    file = ["log_id", "segment_index", "path", "file_bytes"]
    parts = found.groupBy(*file, F.floor((F.col("start") - HEADER_BYTES) / range_bytes).alias("part")).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")
    states = _spread(parts).mapInArrow(check_ranges(key, options), STATES)
    states = states.repartition("log_id").sortWithinPartitions("log_id", "segment_index", "start")
    return _reported(states.mapInArrow(_walk(key.key_id, options, joined(key, options)), REPORT), key)


def violations(report: DataFrame) -> DataFrame:
    return report.select(F.inline("violations"))


def one_segment(frames: DataFrame, segments: DataFrame, key, segment_index: int) -> DataFrame:
    """The violations of one segment, found whatever the segments before it are like."""
    return violations(verify(frames, segments, key, VerifyOptions(forensic=True, cascade=False))).filter(F.col("segment_index") == segment_index)


def report_json(report: DataFrame, key_id: bytes) -> DataFrame:
    """log_id, json: the report as the command line prints it, on one line. Null fields are shown; a clean log has no violation fields."""
    v = F.transform("violations", lambda x: F.struct(x["kind"].alias("kind"), x["segment_index"].alias("segment_index"), x["record_id"].alias("record_id"), x["byte_offset"].alias("byte_offset"), F.concat_ws(": ", x["kind"], x["detail"]).alias("message")))
    log = F.struct(F.col("log_id").alias("log_dir"), F.lit(key_id.hex()).alias("key_id_hex"), "segments_inspected", "records_inspected", "first_segment_index", "last_segment_index", "final_hmac_hex").alias("log")
    head = [F.lit(FORMAT_VERSION).alias("format_version"), F.col("segments_inspected").alias("segments_verified")]
    shown = {"ignoreNullFields": "false"}
    clean = F.to_json(F.struct(F.lit("ok").alias("status"), *head, log), shown)
    rest = F.slice(v, 2, F.greatest(F.size(v), F.lit(1)))
    tampered = F.to_json(F.struct(F.lit("tampered").alias("status"), *head, F.get(v, F.lit(0)).alias("violation"), rest.alias("additional_violations"), log), shown)
    return report.select("log_id", F.when(F.size("violations") == 0, clean).otherwise(tampered).alias("json"))


def raise_on_violation(report: DataFrame) -> None:
    """Raises the typed exception of the first failed log by id."""
    for row in report.filter("verdict <> 'Verified'").orderBy("log_id").limit(1).collect():
        raise BY_KIND.get(row["violations"][0]["kind"], VerificationError)(row["compact"], row)
