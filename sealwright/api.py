"""A log store as one object: append rows, read, verify, recover. Everything that touches rows is a Spark job."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants
from .errors import BY_KIND, SealError, VerificationError
from .functions import cbor
from .functions.records import parsed
from .operators import query
from .operators.recover import FRESH, recover
from .operators.seal import SealConfig, record_inputs, seal
from .operators.verify import VerifyOptions, verify_files
from .sources.lease import Lease
from .sources.ranges import reachable, read_ranges, segment_files
from .sources.segments import list_logs, read_log, write_segments
from .sources.shared import stored

INPUT = "log_id string, seq long, ts_wall string, ts_mono_delta long, actor string, event string, payload binary, schema_version long"


def format_version() -> int:
    return constants.FORMAT_VERSION


def inputs_from_dicts(spark: SparkSession, log_id: str, records: list[dict], first_seq: int = 0) -> DataFrame:
    """Record inputs of dicts: actor and event are required; floats, None and versions beyond 255 are refused."""
    rows = []
    for i, r in enumerate(records):
        missing = {"actor", "event"} - r.keys()
        version = r.get("schema_version", 1)
        if missing or not 0 <= version <= 255:
            raise SealError(f"record {i}: " + (f"no {', '.join(sorted(missing))}" if missing else f"schema_version {version}"))
        rows.append((log_id, first_seq + i, r.get("ts_wall", "1970-01-01T00:00:00.000Z"), r.get("ts_mono_delta", 0), r["actor"], r["event"], cbor.encode(r.get("payload", {})), version))
    d = spark.createDataFrame(rows, INPUT)
    return record_inputs(d, F.col("log_id"), F.col("seq"), F.col("ts_wall"), F.col("ts_mono_delta"), F.col("actor"), F.col("event"), F.col("payload"), F.col("schema_version"))


def inputs_from_json(spark: SparkSession, path: str, log_id: str) -> DataFrame:
    """Record inputs of a JSON document with a ``records`` list; numbers in payloads must be integers."""

    @F.pandas_udf("binary")
    def encoded(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda payload: None if payload is None else cbor.encode(json.loads(payload)))

    schema = "records array<struct<ts_wall:string,ts_mono_delta:long,actor:string,event:string,schema_version:long,payload:variant>>"
    r = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.posexplode("records").alias("seq", "r")).select("seq", "r.*")
    return record_inputs(r, F.lit(log_id), F.col("seq"), F.coalesce("ts_wall", F.lit("1970-01-01T00:00:00.000Z")), F.coalesce("ts_mono_delta", F.lit(0)), F.col("actor"), F.col("event"), encoded(F.to_json("payload")), F.coalesce("schema_version", F.lit(1)))


@dataclass(frozen=True)
class Report:
    """A log's verdict."""

    log_id: str
    ok: bool
    compact: str
    verdict_kind: str
    records_inspected: int
    segments_inspected: int
    final_hmac_hex: str | None
    violations: list

    def raise_on_violation(self) -> None:
        if not self.ok:
            raise BY_KIND.get(self.verdict_kind, VerificationError)(self.compact, self)


class LogStore:
    """A folder of logs under one key and session."""

    def __init__(self, spark: SparkSession, folder: str, key, session: bytes, config: SealConfig = SealConfig()):
        if len(session) != constants.SESSION_BYTES:
            raise SealError(f"a session id has {constants.SESSION_BYTES} bytes")
        self.spark, self.folder, self.key, self.session, self.config = spark, folder, key, session, config
        self.recovery: DataFrame | None = None

    def append(self, inputs: DataFrame) -> DataFrame:
        """Seals the inputs behind what the logs have, after recovery; returns what was written, from a table.

        One writer at a time: the store's lease is held meanwhile, and files are only put in place while it is.
        """
        with Lease(self.folder) as lease:
            states = recover(self.spark, self.folder, self.key) if self._exists() else None
            self.recovery = self._recovery(inputs, states)
            sealed = seal(inputs, self.key, self.session, self.config, states)
            return stored(write_segments(sealed, self.folder, self.key.key_id, lease.token), "written")

    def _recovery(self, inputs: DataFrame, states: DataFrame | None) -> DataFrame:
        """log_id, action and counts of the logs that there are and those that begin."""
        logs = inputs.select(F.col("log_id")).distinct()
        if states is None:
            return logs.withColumn("action", F.lit(FRESH))
        kept = states.select("log_id", "action", "segments_scanned", "truncated_bytes", "last_record_id", "records_in_segment", "last_hmac")
        return kept.join(logs, "log_id", "full").withColumn("action", F.coalesce("action", F.lit(FRESH)))

    @property
    def actions(self) -> dict[str, str]:
        """What the last append() did with each log; for stores of few logs, others read ``recovery``."""
        return {r["log_id"]: r["action"] for r in self.recovery.collect()} if self.recovery is not None else {}

    def _exists(self) -> bool:
        from .errors import LogFormatError

        try:
            return any(True for _ in list_logs(self.folder))
        except LogFormatError:
            return False

    def iterate(self) -> DataFrame:
        """records() in order, as far as a reader that goes from segment 0 to the next comes: a missing segment ends a log."""
        files = reachable(segment_files(self.spark, self.folder))
        whole = files.select("*", F.lit(constants.HEADER_BYTES).cast("long").alias("start"), F.col("file_bytes").alias("end"))
        return parsed(read_ranges(whole).filter("not torn")).orderBy("log_id", *query.ORDER)

    def records(self) -> DataFrame:
        return parsed(read_log(self.spark, self.folder)[0].filter("not torn"))

    def head(self) -> DataFrame:
        return query.head(self.records(), ["log_id"])

    def verify(self, options: VerifyOptions = VerifyOptions()) -> DataFrame:
        return verify_files(self.spark, self.folder, self.key, options)

    def report(self, log_id: str, options: VerifyOptions = VerifyOptions()) -> Report:
        r = self.verify(options).filter(F.col("log_id") == log_id).first()
        found = [v.asDict() for v in r["violations"]]
        return Report(log_id, not found, r["compact"], found[0]["kind"] if found else "Verified", r["records_inspected"], r["segments_inspected"], r["final_hmac_hex"], found)


class Writer:
    """One log of a store for dicts: what append() takes is held until flush(), which seals and writes it in one job."""

    def __init__(self, spark: SparkSession, folder: str, key, session: bytes, log_id: str = "log", config: SealConfig = SealConfig()):
        self.store, self.log_id, self.held, self.first = LogStore(spark, folder, key, session, config), log_id, [], None

    def append(self, record: dict) -> None:
        self.held.append(record)

    def flush(self) -> None:
        if self.held:
            self.store.append(inputs_from_dicts(self.store.spark, self.log_id, self.held))
            self.held = []
            if self.first is None:
                mine = self.store.recovery.filter(F.col("log_id") == self.log_id)
                self.first = mine.select("action", *(["truncated_bytes"] if "truncated_bytes" in mine.columns else [])).first().asDict()

    def recovery_action(self) -> str | None:
        """What the first flush() did with the log that it found; None before."""
        return self.first and self.first["action"]

    def recovery_truncated_bytes(self) -> int:
        return (self.first or {}).get("truncated_bytes") or 0

    def close(self) -> None:
        self.flush()

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, *rest) -> None:
        if kind is None:
            self.close()
