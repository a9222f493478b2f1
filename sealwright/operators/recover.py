"""Recovery of logs after a crash: what each log's last segment allows, and the repair of a torn end, all in tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CHECKS, FINALIZE_EVENT, HEADER_BYTES
from ..errors import RecoveryError
from ..functions import cbor
from ..sources.ranges import _spread, segment_files
from ..sources.segments import durable, filesystem
from ..sources.shared import stored
from .seal import STATE
from .walk import check_range

FRESH, RESUMED, REPAIRED, OPENED_NEXT, REFUSED = "Fresh", "Resumed", "Repaired", "OpenedNextAfterFinalized", "Refused"
#: A row a log: what recovery does; where a refused log failed; the state to go on from (STATE's fields).
RECOVERY = f"log_id string, path string, action string, segments_scanned int, truncated_bytes long, keep_bytes long, last_record_id decimal(20,0), records_in_segment long, last_hmac binary, refused string, refused_record_id decimal(20,0), refused_at long, {STATE}"
NAMES = [x.strip().split()[0] for x in RECOVERY.replace("(20,0)", "").split(", ")]


def peek_record_id(payload: bytes | None) -> int | None:
    """The record id of bytes that may be no record, as far as they are a map that has one."""
    try:
        value = cbor.decode(payload) if payload is not None else None
    except cbor.LogFormatError:
        return None
    found = value.get(1) if isinstance(value, dict) else None
    return found if type(found) is int and found >= 0 else None


def _scanned(source, row: dict, key) -> dict:
    state = check_range(source, HEADER_BYTES, row["file_bytes"], row["segment_index"], key, None)
    fail, last = state["fail"], state["last_record"]
    torn = fail is not None and fail["rank"] == 7
    keep = fail["file_offset"] if torn else row["file_bytes"]
    out = dict.fromkeys(NAMES) | {"log_id": row["log_id"], "path": row["path"], "segments_scanned": 1, "truncated_bytes": row["file_bytes"] - keep, "keep_bytes": keep}
    if state["header_rank"] is not None or (fail and not torn):
        rank = state["header_rank"] if fail is None else fail["rank"]
        return out | {"action": REFUSED, "refused": CHECKS[rank][0], "refused_record_id": peek_record_id(fail and fail["payload"]), "refused_at": fail["file_offset"] if fail else 0, "truncated_bytes": 0}
    head = state["last_hmac"] or state["chain_start"]
    times = {"ts": last[3], "mono": last[4]} if last else {"ts": "", "mono": 0}
    out |= {"last_hmac": head, "last_record_id": last and last[1], "records_in_segment": state["frames"]}
    if last and last[7] == FINALIZE_EVENT:
        return out | {"action": OPENED_NEXT, "segment": row["segment_index"] + 1, "prev_final": head, "offset": HEADER_BYTES, "count": 0, "last": head, "ts": "", "mono": 0}
    return out | {"action": REPAIRED if torn else RESUMED, "segment": row["segment_index"], "prev_final": state["prev_final"], "offset": keep, "count": state["frames"], "last": head, **times}


def plan(spark, folder: str, key) -> DataFrame:
    """RECOVERY rows of the logs below folder; a task reads the last segment of a log. Changes nothing."""
    files = segment_files(spark, folder)
    last = files.groupBy("log_id").agg(F.max_by(F.struct("segment_index", "path", "file_bytes"), "segment_index").alias("f")).select("log_id", "f.*")

    def scan(batches):
        import decimal

        import pyarrow as pa

        whole = {"segments_scanned": pa.int32(), "segment": pa.int32(), **dict.fromkeys(("last_hmac", "prev_final", "last"), pa.binary()), **dict.fromkeys(("log_id", "path", "action", "refused", "ts"), pa.string()), **dict.fromkeys(("last_record_id", "refused_record_id"), pa.decimal128(20, 0))}
        schema = pa.schema([(n, whole.get(n, pa.int64())) for n in NAMES])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                fs, at = filesystem(row["path"])
                with fs.open_input_file(at) as source:
                    found = _scanned(source, row, key)
                for c in ("last_record_id", "refused_record_id"):
                    found[c] = None if found[c] is None else decimal.Decimal(found[c])
                out.append(found)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return _spread(last).mapInArrow(scan, RECOVERY)


def cut(rows: DataFrame) -> DataFrame:
    """path of each file, after cutting it to keep_bytes by a rename of what is kept; repeated attempts give the same."""

    def run(batches):
        import uuid

        import pyarrow as pa

        for batch in batches:
            for path, keep in zip(batch.column("path").to_pylist(), batch.column("keep_bytes").to_pylist()):
                fs, at = filesystem(path)
                kept = f"{at}.{uuid.uuid4().hex}.repair"
                with fs.open_input_file(at) as source:
                    data = source.read(keep)
                with fs.open_output_stream(kept, compression=None) as sink:
                    sink.write(data)
                durable(fs, kept)
                fs.move(kept, at)
            yield pa.RecordBatch.from_arrays([batch.column("path")], ["path"])

    return _spread(rows.select("path", "keep_bytes")).mapInArrow(run, "path string")


def recover(spark, folder: str, key) -> DataFrame:
    """RECOVERY rows, from a table, after torn ends were cut; for seal()'s ``resume``.

    Raises RecoveryError if any log's last segment fails a check other than a torn end; nothing is changed then.
    """
    rows = stored(plan(spark, folder, key), "recovery")
    refused = rows.filter(F.col("action") == REFUSED)
    if shown := refused.orderBy("log_id").limit(10).collect():
        told = ", ".join(f"{r['log_id']}: {r['refused']} at record {r['refused_record_id']}, byte {r['refused_at']}" for r in shown)
        raise RecoveryError(f"{refused.count()} logs can't be extended: {told}")
    cut(rows.filter("truncated_bytes > 0")).write.format("noop").mode("overwrite").save()
    return rows
