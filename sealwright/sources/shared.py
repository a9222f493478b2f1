"""Tables and folders that a job writes for itself, where all executors see them."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local() -> str:
    import tempfile

    return f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"


def scratch(spark: SparkSession, name: str) -> str:
    """URI of a new folder below spark.checkpoint.dir; where that is unset, as in tests, below a new local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or _local()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    uri = fs.makeQualified(path).toString()
    return uri if "://" in uri else uri.replace(":/", ":///", 1)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table that is written once: what several branches of a plan read isn't made several times."""
    path = f"{scratch(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
