"""Benchmark decontamination with spaced seeds: hashes of words at fixed masked places, joined and verified around each hit.

A mask keeps some of the words in a short run and ignores the others, so a run with substituted words still gives an
equal hash wherever the substitutions fall on ignored places. The documents are read once, whatever the benchmark's
size: a bitmap of bounded size drops the seeds that no item has, and what is left is joined with the items' seeds. A seed
that many items have (a phrase that questions begin with) would pair each of them with each document that has it, so such
a seed is extended by one more word at a fixed distance: of a run's other words at most a few are substituted, so the
keys with the few that the fewest items share are enough, and none is lost. Hits
are verified along their diagonal: some run of MIN_WORDS words (the whole item where it is shorter) must agree in at
least SIMILARITY of its words. Equal texts are one text until the last join.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import words, written

#: Any 2 substitutions in 10 words or more leave one of these whole somewhere (tested); each keeps five words.
MASKS = ("11111", "111011", "11010011")
#: Any substitution in 5 words or more leaves one of these whole; for items of 5 to 9 words, which may have just one.
SHORT_MASKS = ("1111", "10111", "11011", "11101")
SHORT_WORDS = 10
#: Items of fewer words must match in all of them, and are one seed.
WHOLE_WORDS = 5
MIN_WORDS, SIMILARITY = 13, 0.8
#: Seeds that more than so many places in items have are extended by one more word.
HOT_PLACES = 16
#: The bitmap of the benchmark's seeds: so many bits a seed, 2 ** 27 bits (16 MB) at most; a fuller one drops fewer seeds.
BITS_PER_SEED, MOST_BITS = 64, 1 << 27
#: The items that a text may overlap with are verified in so many parts.
PARTS = 64


def hashes_of(clean: Column) -> Column:
    """64-bit hashes of the words of a cleaned text (words()), in order."""
    return F.transform(F.filter(F.split(clean, " "), lambda w: w != ""), lambda w: F.xxhash64(w))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words, in order; none for null and for texts without words."""
    return hashes_of(words(text))


def seeds(hashes, mask: str):
    """The hash of the mask and of the kept words at each place where the mask fits."""
    import numpy as np

    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            out += hashes[i : i + n]
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def places(keys, bits: int):
    """The two places of each seed in the bitmap."""
    import numpy as np

    return keys % np.uint64(bits), (keys * np.uint64(0xA0761D6478BD642F) >> np.uint64(20)) % np.uint64(bits)


def held(bitmap, keys):
    """Where the keys are that the bitmap, an array of 64-bit words, may hold."""
    import numpy as np

    at = np.arange(len(keys))
    for p in places(keys, 64 * len(bitmap)):
        at = at[(bitmap[p[at] >> np.uint64(6)] >> (p[at] & np.uint64(63))) & np.uint64(1) != 0]
    return at


def extended(seeds, distance: int, words):
    """The seeds' hashes with a word each that is so far from the mask's first place."""
    import numpy as np

    out = (seeds ^ np.uint64((distance + 64) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xA0761D6478BD642F)
    out ^= out >> np.uint64(32)
    out = (out + words) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def masks_of(n: int) -> tuple:
    """The masks for an item of n words."""
    return ("1" * n,) * (n > 0) if n < WHOLE_WORDS else SHORT_MASKS if n < SHORT_WORDS else MASKS


def run_and_misses(n: int) -> tuple[int, int]:
    """How long the runs are that an item of n words must agree in, and how many of a run's words may differ."""
    size = min(MIN_WORDS, n)
    return size, size - math.ceil(SIMILARITY * size - 1e-9)


def distances(mask: str) -> list[int]:
    """Where the other words of a run that has the whole mask can be, from the mask's first place."""
    return [i for i in range(len(mask) - MIN_WORDS, MIN_WORDS) if not (0 <= i < len(mask) and mask[i] == "1")]


SEEDS = "array<struct<seed:long,place:int>>"


def item_seeds(hashes: Column) -> Column:
    """The seeds of items' words, with the masks as numbers."""

    @F.pandas_udf("array<struct<seed:long,place:int,mask:int>>")
    def find(batch: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for h in batch:
            h = np.asarray(h, np.int64).view(np.uint64)
            out.append([{"seed": x, "place": i, "mask": int(mask, 2)} for mask in masks_of(len(h)) for i, x in enumerate(seeds(h, mask).view(np.int64).tolist())])
        return pd.Series(out)

    return find(hashes)


def item_extensions(hashes: Column, seed: Column, place: Column, mask: Column) -> Column:
    """All extensions of seeds at their places in items: distance and key."""

    @F.pandas_udf("array<struct<distance:int,key:long>>")
    def find(hashes: pd.Series, seed: pd.Series, place: pd.Series, mask: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for h, s, at, m in zip(hashes, seed.to_numpy(np.int64).view(np.uint64), place, mask):
            h = np.asarray(h, np.int64).view(np.uint64)
            there = [i for i in distances(f"{m:b}") if 0 <= at + i < len(h)]
            keys = [extended(np.array([s]), i, h[at + i : at + i + 1]).view(np.int64)[0] for i in there]
            out.append([{"distance": i, "key": int(k)} for i, k in zip(there, keys)])
        return pd.Series(out)

    return find(hashes, seed, place, mask)


def enough(n: int, place: int, span: int, found: list[tuple[int, int, int]]) -> set[int]:
    """Keys of (places that have it, distance, key) of which a run that agrees has at least one, whatever run it is.

    A run has the mask and other words, of which no more than its misses differ: so one more than these is enough of
    each run, and the rarest are taken.
    """
    size, misses = run_and_misses(n)
    out: set[int] = set()
    for start in range(max(0, place + span - size), min(place, n - size) + 1):
        mine = sorted(x for x in found if start <= place + x[1] < start + size)
        out.update(key for _, _, key in mine[: misses + 1])
    return out


def document_seeds(hashes: Column, bitmap, hot, masks: tuple) -> Column:
    """The seeds of documents' words, and the extensions of those that are in the bitmap hot (None: of none), that are in
    the bitmap; both are broadcast arrays of 64-bit words."""

    @F.pandas_udf(SEEDS)
    def find(batch: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for h in batch:
            h, found = np.asarray(h, np.int64).view(np.uint64), []
            for mask in masks:
                s = seeds(h, mask)
                at = held(bitmap.value, s)
                found += [{"seed": x, "place": i} for x, i in zip(s[at].view(np.int64).tolist(), at.tolist())]
                at = held(hot.value, s) if hot else at[:0]
                for i in distances(mask) if len(at) else ():
                    here = at[(at + i >= 0) & (at + i < len(h))]
                    keys = extended(s[here], i, h[here + i])
                    there = held(bitmap.value, keys)
                    found += [{"seed": x, "place": p} for x, p in zip(keys[there].view(np.int64).tolist(), here[there].tolist())]
            out.append(found)
        return pd.Series(out)

    return find(hashes)


def item_keys(items: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """item_key, seed, place: what documents' seeds are joined with, extensions in the place of seeds that many places
    have; and a table of those seeds (seed), None if there are none. An item of five words stays with its seeds, as
    four of them are an overlap."""
    keys = written(items.select("item_key", F.size("hashes").alias("n"), F.explode(item_seeds(F.col("hashes"))).alias("s")).select("item_key", "n", "s.*"), "item-seeds")
    hot = written(keys.groupBy("seed").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT_PLACES).select("seed"), "hot-seeds")
    if hot.isEmpty():
        return keys.select("item_key", "seed", "place"), None

    @F.pandas_udf("array<long>")
    def choose(n: pd.Series, place: pd.Series, mask: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([sorted(enough(a, b, m.bit_length(), [(x["c"], x["distance"], x["key"]) for x in f])) for a, b, m, f in zip(n, place, mask, found)])

    marked = written(keys.join(hot.withColumn("hot", F.lit(True)), "seed", "left").withColumn("hot", F.col("hot").isNotNull() & (F.col("n") > WHOLE_WORDS)), "marked-seeds")
    more = marked.filter("hot").join(items, "item_key")
    more = more.select("item_key", "n", "place", "mask", F.explode(item_extensions(F.col("hashes"), F.col("seed"), F.col("place"), F.col("mask"))).alias("x")).select("item_key", "n", "place", "mask", "x.*")
    more = written(more, "extensions")
    counts = written(more.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "extension-counts")
    more = more.join(counts, "key").groupBy("item_key", "n", "place", "mask").agg(F.collect_list(F.struct("c", "distance", "key")).alias("found"))
    more = more.select("item_key", F.explode(choose(F.col("n"), F.col("place"), F.col("mask"), F.col("found"))).alias("seed"), "place")
    return written(marked.filter("not hot").select("item_key", "seed", "place").unionByName(more), "item-keys"), hot


def bitmap_of(keys: DataFrame, n: int):
    """The bitmap of a table of n seeds, as an array of 64-bit words; the driver gets no more than its words that aren't 0."""
    import numpy as np

    bits = min(MOST_BITS, max(1 << 12, 1 << (BITS_PER_SEED * n).bit_length()))

    @F.pandas_udf("array<long>")
    def both(batch: pd.Series) -> pd.Series:
        p = places(batch.to_numpy(np.int64).view(np.uint64), bits)
        return pd.Series(list(np.stack(p, axis=1).astype(np.int64)))

    at = keys.select(F.explode(both("seed")).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
    rows = at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def best_overlap(doc, item, diagonals) -> tuple[int, int, int, int] | None:
    """(doc_start, item_start, n_words, n_matches) of the best run along the diagonals (a document's place minus an item's)."""
    import numpy as np

    size, best = min(MIN_WORDS, len(item)), None
    for diagonal in sorted(diagonals):
        a, b = max(0, -diagonal), min(len(item), len(doc) - diagonal)
        if b - a < size:
            continue
        same = np.cumsum(np.concatenate([[0], doc[a + diagonal : b + diagonal] == item[a:b]]))
        runs = same[size:] - same[:-size]
        if (m := int(runs.max())) >= math.ceil(SIMILARITY * size - 1e-9) and (best is None or m > best[3]):
            k = int(runs.argmax())
            best = a + k + diagonal, a + k, size, m
    return best


OVERLAP = "doc_key binary, item_key binary, doc_start int, item_start int, n_words int, n_matches int"


def verify(texts, pairs):
    """Of a text's part: its words' hashes, and the items (with their words' hashes) and diagonals to look at."""
    import numpy as np
    import pyarrow as pa

    kinds = [pa.binary(), pa.binary(), *[pa.int32()] * 4]
    rows = []
    if texts.num_rows and pairs.num_rows:
        key, doc = texts.column("doc_key")[0].as_py(), texts.column("hashes")[0].values.to_numpy()
        for item_key, hashes, diagonals in zip(pairs.column("item_key").to_pylist(), pairs.column("hashes"), pairs.column("diagonals").to_pylist()):
            if found := best_overlap(doc, hashes.values.to_numpy(), diagonals):
                rows.append((key, item_key, *found))
    columns = list(zip(*rows)) if rows else [[]] * 6
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in OVERLAP.split(", ")])


def key_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """OVERLAP: the best verified overlap of each text and item that overlap; keys are digests of the texts. A written table."""
    items = written(benchmark.select(key_of(F.col("text")).alias("item_key"), "text").dropDuplicates(["item_key"]).select("item_key", word_hashes(F.col("text")).alias("hashes")), "items")
    keys, hot = item_keys(items)
    broadcast = docs.sparkSession.sparkContext.broadcast
    bitmap, of_hot = broadcast(bitmap_of(keys, keys.count())), None if hot is None else broadcast(bitmap_of(hot, hot.count()))
    lengths = items.select(F.least(F.size("hashes"), F.lit(SHORT_WORDS)).alias("n")).distinct().collect()  # SHORT_WORDS + 1 at most
    masks = tuple(sorted({mask for r in lengths for mask in masks_of(r["n"])}))
    hits = docs.select(key_of(F.col("text")).alias("doc_key"), word_hashes(F.col("text")).alias("hashes"))
    hits = hits.select("doc_key", F.explode(document_seeds(F.col("hashes"), bitmap, of_hot, masks)).alias("s")).select("doc_key", F.col("s.seed").alias("seed"), F.col("s.place").alias("doc_place")).distinct()
    # both sides are tables, so that the join can split a seed that many documents have
    pairs = written(hits, "seed-hits").join(keys, "seed").select("doc_key", "item_key", (F.col("doc_place") - F.col("place")).alias("diagonal"))
    pairs = written(pairs.groupBy("doc_key", "item_key").agg(F.collect_set("diagonal").alias("diagonals")), "seed-pairs")
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("item_key"), F.lit(PARTS)).cast("int"))
    wanted = written(pairs.select("doc_key", "part").distinct(), "seed-texts")
    texts = docs.select(key_of(F.col("text")).alias("doc_key"), "text").join(wanted.select("doc_key").distinct(), "doc_key", "left_semi").dropDuplicates(["doc_key"])
    texts = texts.select("doc_key", word_hashes(F.col("text")).alias("hashes")).join(wanted, "doc_key")
    pairs = pairs.join(items, "item_key")
    found = texts.groupBy("doc_key", "part").cogroup(pairs.groupBy("doc_key", "part")).applyInArrow(verify, OVERLAP)
    return written(found, "overlaps")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_start, item_start (in words), n_words, n_matches, similarity: one row per document and item that overlap.

    Case and punctuation don't count. Items of fewer than WHOLE_WORDS words must match in all of them; null texts, texts
    without words and empty tables have no overlaps; a repeated document or item has rows of its own, and so has one without an id.
    """
    found = overlaps(docs, benchmark)
    items = benchmark.select("item_id", key_of(F.col("text")).alias("item_key"))
    rows = docs.select("doc_id", key_of(F.col("text")).alias("doc_key")).join(found, "doc_key").join(items, "item_key")
    return rows.select("doc_id", "item_id", "doc_start", "item_start", "n_words", "n_matches", (F.col("n_matches") / F.col("n_words")).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no item, with their columns; rows with null or empty text stay, repeated rows stay or go together."""
    found = overlaps(docs, benchmark).select(F.col("doc_key").alias("__key")).distinct()
    found = written(found, "contaminated-texts")
    return docs.join(found, key_of(docs["text"]) == F.col("__key"), "left_anti")
