"""Importance resampling towards a target distribution: array-scored weights, ranks by sorting with regular sampling.

Features are runs of words, hashed into buckets. Each task counts its documents' buckets in one array and scores them
with another, the buckets' gains. Ranks come without a total order in one task: each task sorts its scored rows into a
run; rows at regular places of all runs give the splitters; rows that can be drawn are exchanged by them and merged; and
the counts of the ranges before a row's own turn its place there into its exact rank.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: A-Z in lower case, other ASCII but digits and letters as spaces.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Samples that the driver takes at most; more are ranked by the same method first.
SAMPLES = 200_000
#: Rows of a range, as planned.
RANGE_ROWS = 1_000_000


@dataclass(frozen=True)
class Resampling:
    buckets: int = 10_000
    max_run: int = 1
    seed: int = 2024
    least_words: int = 20
    percent: int = 10
    #: What gains, and the noise, are multiplied by before they are floored.
    scale: int = 1000


def hashes(text: str | None, max_run: int) -> tuple[np.ndarray, int]:
    """(crc32 of each feature, number of words); null has none."""
    words = text.encode().translate(FOLD).split() if text else []
    runs = list(map(zlib.crc32, words))
    out = [runs]
    for n in range(1, max_run):
        runs = [zlib.crc32(b" " + w, h) for h, w in zip(runs, words[n:])]
        out.append(runs)
    return np.fromiter((h for r in out for h in r), np.int64, sum(map(len, out))), len(words)


def bucket_counts(texts: DataFrame, column: str, o: Resampling) -> np.ndarray:
    """Features in each bucket, of all rows. A task adds up an array; only its buckets are shuffled, and ``buckets`` rows collected."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(o.buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                h, _ = hashes(text, o.max_run)
                total += np.bincount(h % o.buckets, minlength=o.buckets) if len(h) > o.buckets // 8 else 0
                if len(h) <= o.buckets // 8:
                    np.add.at(total, h % o.buckets, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(o.buckets, np.int64)
    for r in texts.select(column).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, o: Resampling) -> np.ndarray:
    """floor(scale * ln of the smoothed shares' ratio) of each bucket."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(o.scale * np.log((t + 1) * (s.sum() + o.buckets) / ((s + 1) * (t.sum() + o.buckets)))).astype(np.int64)


def noise(doc_id: int | None, o: Resampling) -> int:
    """Gumbel noise of a document from its id and the seed; a null id is an empty one."""
    h = int(hashlib.sha256(f"{o.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return int(np.floor(-o.scale * np.log(-np.log((h + 0.5) / 4294967296))))


def scored(docs: DataFrame, gain: np.ndarray, o: Resampling) -> DataFrame:
    """doc_id, n_features, n_words, weight, score of each row."""

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, words = hashes(text, o.max_run)
                weight = int(gain[h % o.buckets].sum())
                rows.append((doc_id, len(h), words, weight, weight + noise(doc_id, o)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "n_features", "n_words", "weight", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, n_features long, n_words long, weight long, score long")


def sorted_runs(rows: DataFrame, *before) -> DataFrame:
    """The rows as a table of runs, each in the order of (before, down, doc_id); place is a row's own number, ascending in a run.

    (down, doc_id, place) differs between any two rows, so that ties and repeated rows divide like all others.
    """
    order = [*before, F.col("down").asc(), F.col("doc_id").asc_nulls_first()]
    return written(rows.sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "resampling-runs")


KEY = ("down", "no_id", "doc_id", "place")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select("down", F.col("doc_id").isNotNull().cast("long").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "place")


def splitters(runs: DataFrame, ranges: int) -> list[tuple]:
    """Keys that divide the runs into about equal ranges: rows at regular places of each run, ranked, and of these regular ones.

    With as many samples as runs times ranges no range gets more than twice its share of the rows. While that is too many
    for the driver, they are thinned by rank with the same method.
    """
    n, many = runs.agg(F.count(F.lit(1)), F.count_distinct(F.shiftright("place", 33))).first()
    if ranges < 2 or n < 2:
        return []
    step = max(1, n // (many * ranges))
    # a run's places are consecutive numbers from a multiple of 2 ** 33
    samples = _keyed(runs.filter(F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) % step == 0))
    count = samples.count()
    if count > SAMPLES:
        renamed = samples.select("down", F.when(F.col("no_id") == 1, F.col("doc_id")).alias("doc_id"), F.col("place").alias("own"))
        again = ranked(sorted_runs(renamed), None, max(2, count // SAMPLES))
        every = -(-count // SAMPLES)
        samples = _keyed(again.filter(F.col("rank") % every == 0).drop("place").withColumnRenamed("own", "place"))
    keys = sorted(tuple(r) for r in samples.collect())
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)})


def ranked(runs: DataFrame, draw: int | None, ranges: int | None = None) -> DataFrame:
    """The rows of runs with rank 1, 2, 3, ... in order; rows behind the first ``draw`` have none and, if their whole range is behind, don't move."""
    spark = runs.sparkSession
    total = runs.count()
    cuts = splitters(runs, ranges or max(spark.sparkContext.defaultParallelism, -(-total // RANGE_ROWS)))
    width = len(cuts) + 1
    columns = [*runs.columns]

    @F.pandas_udf("long")
    def range_of(down, no_id, doc_id, place):
        import pandas as pd

        return pd.Series([bisect.bisect_right(cuts, k) for k in zip(down, no_id, doc_id, place)], dtype="int64")

    k = (F.col("down"), F.col("doc_id").isNotNull().cast("long"), F.coalesce("doc_id", F.lit(0)), F.col("place"))
    dealt = written(runs.withColumn("__range", range_of(*k)), "resampling-ranges")
    sizes = dict(dealt.groupBy("__range").count().collect())  # a row a range
    before = np.concatenate([[0], np.cumsum([sizes.get(i, 0) for i in range(width)])]).tolist()
    last = width if draw is None else bisect.bisect_left(before, draw)  # ranges from here on have no drawn row
    far = dealt.filter(F.col("__range") >= last).select(*columns, F.lit(None).cast("long").alias("rank"))
    near = dealt.filter(F.col("__range") < last).repartitionById(max(1, last), F.col("__range").cast("int"))
    near = near.sortWithinPartitions("__range", F.col("down").asc(), F.col("doc_id").asc_nulls_first(), F.col("place").asc())

    def number(batches):
        import pyarrow as pa

        now, at = None, 0
        for batch in batches:
            ranks = []
            for r in batch.column("__range").to_pylist():
                if r != now:
                    now, at = r, before[r]
                at += 1
                ranks.append(at if draw is None or at <= draw else None)
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ranks, pa.int64())], [*columns, "rank"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema.fields)
    return near.mapInArrow(number, f"{fields}, rank long").unionByName(far)


def resample(docs: DataFrame, target: DataFrame, o: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank orders the drawn ones, others have none.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) with the highest scores are drawn, ties to
    the smaller doc_id (null first), then rows that agree in both in any order, each with a rank of its own. Null, empty and
    wordless texts have no features and weight 0. Empty tables give no rows; an empty target gives every bucket's share 1.
    """
    gain = gains(bucket_counts(docs, "text", o), bucket_counts(target, "text", o), o)
    rows = scored(docs, gain, o).withColumn("down", -F.col("score"))
    all_rows = sorted_runs(rows, F.col("n_words") < o.least_words)
    can = all_rows.filter(F.col("n_words") >= o.least_words)
    draw = o.percent * can.count() // 100
    short = all_rows.filter(F.col("n_words") < o.least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked(can, draw).unionByName(short).select("doc_id", "n_features", "weight", "score", "rank")
