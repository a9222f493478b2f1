"""The export report of a log as rows of text: cover, verdict, provenance, sample records, format reference.

Layout is left to whoever prints the rows; the digest over them is reproducible, as no clock is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FORMAT_VERSION, FRAME_OVERHEAD, HEADER_BYTES, SAMPLE_ROWS
from .query import as_text
from .verify import VerifyOptions, decoded, verify


def export_lines(frames: DataFrame, segments: DataFrame, key, full: bool = False, options: VerifyOptions = VerifyOptions()) -> DataFrame:
    """log_id, part, line_no, line. Parts 1 to 5; of more than 2 * SAMPLE_ROWS records the first and last SAMPLE_ROWS are listed unless full."""
    report = verify(frames, segments, key, options)
    lines = [
        (1, F.concat(F.lit("Audit log "), "log_id")),
        (2, F.col("summary")),
        (3, F.concat(F.lit("key_id "), F.lit(key.key_id.hex()), F.lit(", segments "), F.col("segments_inspected").cast("string"), F.lit(", records "), F.col("records_inspected").cast("string"))),
        (5, F.lit(f"format {FORMAT_VERSION}: {HEADER_BYTES}-byte segment headers, {FRAME_OVERHEAD} bytes of framing a record, HMAC-SHA256 chain")),
    ]
    fixed = report.select("log_id", F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(0).cast("long").alias("line_no"), t.alias("line")) for p, t in lines])))
    place = Window.partitionBy("log_id").orderBy("segment_index", "file_offset")
    rows = decoded(frames.filter("not torn")).withColumn("n", F.row_number().over(place).cast("long"))
    if not full:
        count = frames.filter("not torn").groupBy("log_id").agg(F.count(F.lit(1)).alias("total"))
        rows = rows.join(count, "log_id").filter((F.col("n") <= SAMPLE_ROWS) | (F.col("n") > F.col("total") - SAMPLE_ROWS))
    return fixed.unionByName(rows.select("log_id", F.lit(4).alias("part"), F.col("n").alias("line_no"), as_text("<bytes>").alias("line")))


def digests(lines: DataFrame) -> DataFrame:
    """log_id, lines, sha256: over each log's lines' own digests in order."""
    each = F.struct("part", "line_no", F.sha2("line", 256).alias("d"))
    return lines.groupBy("log_id").agg(F.count(F.lit(1)).alias("lines"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(each)), lambda x: x["d"])), 256).alias("sha256"))
