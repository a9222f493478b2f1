"""Streams: following live logs, sealing a stream of record inputs with the chain as state, and writing it to files."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..errors import SealError
from ..functions.expressions import record_tail
from ..operators.seal import SEALED, STATE, Chain, SealConfig, checked
from ..sources.segments import AuditLogs, filesystem

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a log and micro-batch that a task holds; more go to sorted runs in the shared folder.
HELD_ROWS = 200_000
PIECE = 10_000


def tail(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Frames of a live log or store as a stream; a record appears in the batch after it is whole."""
    spark.dataSource.register(AuditLogs)
    return spark.readStream.format("audit_logs").options(**options).load(folder)


def in_order(batches: Iterator[pd.DataFrame], by: str, folder: str | None, most: int = HELD_ROWS) -> Iterator[pd.DataFrame]:
    """The batches' rows in the order of a column, a piece at a time: sorted runs of at most ``most`` rows, merged from files."""
    import pyarrow as pa

    runs, held, rows = [], [], 0

    def run() -> pd.DataFrame:
        return pd.concat(held, ignore_index=True).sort_values(by, kind="stable")

    def read(path: str) -> Iterator[tuple]:
        with fs.open_input_file(path) as source:
            with pa.ipc.open_file(source) as stored:
                for i in range(stored.num_record_batches):
                    yield from stored.get_batch(i).to_pandas().itertuples(index=False, name=None)
        fs.delete_file(path)

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= most:
            if folder is None:
                raise SealError("sorted runs need a shared folder: set spark.checkpoint.dir")
            fs, base = filesystem(folder)
            fs.create_dir(base)
            runs.append(f"{base}/{uuid.uuid4().hex}.run")
            table = pa.Table.from_pandas(run(), preserve_index=False)
            with fs.open_output_stream(runs[-1], compression=None) as out, pa.ipc.new_file(out, table.schema) as stored:
                stored.write_table(table, max_chunksize=PIECE)
            held, rows = [], 0
    if not runs:
        whole = run()
        yield from (whole.iloc[i : i + PIECE] for i in range(0, len(whole), PIECE))
        return
    names = table.schema.names
    at = names.index(by)
    last = run().itertuples(index=False, name=None) if held else iter(())
    piece = []
    for row in heapq.merge(*map(read, runs), last, key=lambda r: r[at]):
        piece.append(row)
        if len(piece) == PIECE:
            yield pd.DataFrame(piece, columns=names)
            piece = []
    if piece:
        yield pd.DataFrame(piece, columns=names)


class Sealer(StatefulProcessor):
    """One chain a log; its state is where the chain stands, so it doesn't grow with the log."""

    def __init__(self, key, session: bytes, config: SealConfig, folder: str | None, most: int):
        self.key, self.session, self.config, self.folder, self.most = key, session, config, folder, most

    def init(self, handle) -> None:
        self.chain = handle.getValueState("chain", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chain = Chain.of(key[0], self.key, self.session, self.config, self.chain.get() if self.chain.exists() else None)
        before = None
        for piece in in_order(rows, "seq", self.folder, self.most):
            out = []
            for seq, tail_bytes, ts, mono in zip(piece["seq"], piece["tail"], piece["ts_wall"], piece["ts_mono_delta"]):
                if seq == before:
                    raise SealError(f"log {key[0]} has two records {seq} in a batch")
                before = seq
                out.extend(chain.append(bytes(tail_bytes), (ts, int(mono))))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SEALED.split(", ")])
        self.chain.update(chain.state())

    def close(self) -> None:
        pass


def seal_stream(inputs: DataFrame, key, session: bytes, config: SealConfig = SealConfig(), held_rows: int = HELD_ROWS, runs: str | None = None) -> DataFrame:
    """SEALED rows of a stream of record inputs. Arrival order is chain order from batch to batch, seq within a batch.

    Nothing is dropped as late: a clock that runs backwards is for verification to report. The state lies in RocksDB, which
    the session is set to. A log's rows of a batch are taken from the iterator; beyond ``held_rows`` they are sorted in runs
    in the shared folder ``runs``, below spark.checkpoint.dir if not given, so that a log may have any share of a batch.
    """
    spark = inputs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    runs = runs or (shared and f"{shared.rstrip('/')}/seal-runs")
    tail_bytes = record_tail(F.col("ts_wall"), F.col("ts_mono_delta"), session, F.col("actor"), F.col("event"), F.col("payload"), key.key_id, F.col("schema_version"))
    rows = checked(inputs).select("log_id", "seq", "ts_wall", "ts_mono_delta", tail_bytes.alias("tail"))
    sealer = Sealer(key, session, config, runs, held_rows)
    return rows.groupBy("log_id").transformWithStateInPandas(sealer, SEALED, "Append", "None")


def write_sealed(sealed: DataFrame, folder: str, key_id: bytes, checkpoint: str):
    """A DataStreamWriter of seal_stream()'s rows to segment files below folder, each epoch once; call start() on it."""
    sealed.sparkSession.dataSource.register(AuditLogs)
    return sealed.writeStream.format("audit_logs").option("key_id", key_id.hex()).option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
