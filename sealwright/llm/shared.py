"""Helpers that several operators share: the shared folder, files in it, and text cleaning."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are worked off in pieces of about so many bytes of text, which bounds a Python worker's memory.
PIECE_BYTES = 4 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder below ``spark.checkpoint.dir``; without that setting (tests) below a new local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = fs.makeQualified(path).toString()
    fs.mkdirs(path)
    return uri if "://" in uri else uri.replace(":/", ":///", 1)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, from a table written once to the shared folder; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; for use in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def attempt_name(prefix: str, suffix: str) -> str:
    """A file name that no other attempt of any task uses; a manifest lists the files of the attempts that count."""
    task = TaskContext.get()
    return f"{prefix}-{task.partitionId():06d}-{task.taskAttemptId()}{suffix}"


def cuts(values):
    """(start, length) of the parts of an Arrow array of strings or binaries that hold about PIECE_BYTES or a single value each."""
    import pyarrow.compute as pc

    start = total = 0
    sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    for i, size in enumerate(sizes):
        if total and total + size > PIECE_BYTES:
            yield start, i - start
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes) - start


def pieces(batches, text_column: str):
    """The Arrow batches, cut so that each holds about PIECE_BYTES of text or a single row."""
    for batch in batches:
        for start, n in cuts(batch.column(text_column)):
            yield batch.slice(start, n)


def lists(arrays):
    """The values of the Arrow arrays as Python lists of about PIECE_BYTES or a single value each."""
    for values in arrays:
        for start, n in cuts(values):
            yield values.slice(start, n).to_pylist()


def letters(text: Column) -> Column:
    """Lower-case text in which each run of characters that aren't letters is one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def words(text: Column) -> Column:
    """Lower-case text in which each run of characters that aren't letters, marks or digits is one space; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))
