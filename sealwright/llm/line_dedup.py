"""Line dedup by overlapping three-line windows, in DataFrame operations alone.

Every run of three consecutive lines is hashed; windows that occur more than once anywhere lose all occurrences but
the first (by document, then by line), and the lines that the removed windows cover go. Covered runs merge, as a line
goes once however many windows cover it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

LINES_PER_WINDOW = 3


def lines_of(text: Column) -> Column:
    """The lines between line feeds; null has none, empty text has one empty line."""
    return F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))


def windows(docs: DataFrame, size: int = LINES_PER_WINDOW) -> DataFrame:
    """doc_id, copy (a hash of the text), line (of the window's start, from 0), h1 and h2: the window's 128-bit hash."""
    at = lambda i, k: F.get(F.col("lines"), i + k)
    starts = F.when(F.size("lines") >= size, F.sequence(F.lit(0), F.size("lines") - size)).otherwise(F.array().cast("array<int>"))
    both = lambda i: F.struct(i.alias("line"), F.xxhash64(*[at(i, k) for k in range(size)]).alias("h1"), F.xxhash64(F.lit(size), *[at(i, k) for k in reversed(range(size))]).alias("h2"))
    d = docs.select("doc_id", F.xxhash64("text").alias("copy"), lines_of(F.col("text")).alias("lines"))
    return d.select("doc_id", "copy", F.inline(F.transform(starts, both)))


def covered_starts(docs: DataFrame, size: int = LINES_PER_WINDOW) -> DataFrame:
    """doc_id, copy, starts: where windows begin that occur earlier, in this document or in one with a smaller doc_id.

    The first occurrence of each window is aggregated before its shuffle, and so is the count; only windows that
    occur twice or more meet the occurrences again, from a table, so that the join can split a hot window. Rows that share doc_id and
    text are one document.
    """
    w = windows(docs, size)
    place = F.struct("doc_id", "copy", "line")
    firsts = written(w.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("h1", "h2", "first"), "first-windows")
    later = w.join(firsts, ["h1", "h2"]).filter(place > F.col("first"))
    return later.groupBy("doc_id", "copy").agg(F.collect_set("line").alias("starts"))


def dedup_lines(docs: DataFrame, size: int = LINES_PER_WINDOW) -> DataFrame:
    """docs with kept_text, n_lines, n_removed and n_spans (runs of removed lines); columns of docs so named are replaced.

    Null text stays null with no lines; texts of fewer lines than a window lose none; rows without doc_id come
    first; rows that repeat an earlier doc_id with another text follow in the order of the texts' hashes.
    """
    mine = ("kept_text", "n_lines", "n_removed", "n_spans")
    kept = [c for c in docs.columns if c not in mine]
    d = docs.select(*kept, F.xxhash64("text").alias("__copy")).alias("d")
    found = covered_starts(docs, size).alias("f")
    d = d.join(found, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.__copy") == F.col("f.copy")), "left")
    d = d.select(*[F.col(f"d.{c}").alias(c) for c in kept], F.array_sort(F.col("f.starts")).alias("__starts"))
    lines = lines_of(F.col("text"))
    covered = F.when(F.col("__starts").isNull(), F.array().cast("array<int>")).otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform("__starts", lambda s: F.sequence(s, s + size - 1))))))
    d = d.withColumn("__covered", covered)
    # the removed lines are ascending: those without a removed line just before them begin a span
    spans = F.size(F.filter("__covered", lambda x, i: (i == 0) | (F.get(F.col("__covered"), i - 1) < x - 1)))
    pieces = F.array_except(F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0))), F.col("__covered"))
    text = F.when(F.size("__covered") == 0, F.col("text")).otherwise(F.array_join(F.transform(pieces, lambda i: F.get(F.col("__lines"), i)), "\n"))
    d = d.withColumn("__lines", lines)
    return d.select(*kept, text.alias("kept_text"), F.size("__lines").cast("long").alias("n_lines"), F.size("__covered").cast("long").alias("n_removed"), spans.cast("long").alias("n_spans"))
