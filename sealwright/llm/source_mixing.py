"""Mixing sources to target weights: equal-token blocks, dealt to sources and shards by Sainte-Lague apportionment.

A source's documents are dealt to shards by a hash; a shard's documents, in seeded order, form one run of words that
is cut into blocks of (nearly) BLOCK_WORDS. Sources get blocks by the highest quotients target / (2 k + 1), then each
source's blocks are dealt to its regions (REGION shards each) and each region's to its shards in the same way, which
gives integer quotas. Within a shard every block is taken quota div blocks times, and a seeded choice of quota mod
blocks of them once more. The text is read once for its words; sizes and hashes then come from a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WORD = r"[^\x20\x09-\x0D]+"
WORD_WITH_SPACE = r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"
BLOCK_WORDS = 64
#: A shard holds about so many words, however large a source is; so many shards are a region.
SHARD_WORDS, REGION = 200_000, 4096
MOST_COPIES = 3
WEIGHTS = (5, 2, 1)
#: Multipliers for the seeded choice of blocks; prime, so that they permute the blocks.
PRIMES = (1_000_003, 1_299_709, 15_485_863, 32_452_843, 49_979_687, 67_867_967, 86_028_121, 104_395_301)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sizes (source, source_size) with target: shares by weight, at most ``most`` times the size, the excess reshared by weight.

    One row per source passes through the two windows. With sources in the order of most * size / weight, those that
    stop at their limit come first; the first that doesn't fixes the words per unit of weight of all that follow.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("weight", F.element_at(ws, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("limit", F.col("source_size").cast("double") * most).withColumn("ratio", F.col("limit") / F.col("weight"))
    ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy(F.lit(0)))
    s = s.withColumn("unit", (total - before) / left)
    unit = F.min(F.when(F.col("unit") <= F.col("ratio"), F.struct("ratio", "unit"))).over(Window.partitionBy(F.lit(0)))["unit"]
    return s.withColumn("target", F.coalesce(F.least(F.col("limit"), F.col("weight") * unit), F.col("limit"))).select("source", "source_size", "target")


def apportion(df: DataFrame, group: list[str], key: str, weight: str, seats: str, most: str) -> DataFrame:
    """df with quota: the group's ``seats`` (a column, equal within a group) by Sainte-Lague, at most ``most`` for a row.

    Each row surely gets all seats but a few next to its rounded share; only those few are ranked by their quotients
    weight / (2 k + 1), ties by key. With n rows whose rounded shares miss the seats by D, a row's share moves by at most its part of
    D + n, plus 1, so the ranked seats number a few per row, whatever the seats number.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    total = F.sum(weight).over(g)
    share = F.when(F.col("__total") > 0, F.col(weight) * F.col(seats) / F.col("__total")).otherwise(0.0)
    d = df.withColumn("__total", total).withColumn("__near", F.floor(share + 0.5).cast("long"))
    spare = (F.abs(F.col(seats) - F.sum("__near").over(g)) + F.count(F.lit(1)).over(g)) / F.col("__total")
    d = d.withColumn("__width", F.when(F.col("__total") > 0, F.ceil(F.col(weight) * spare).cast("long") + 1).otherwise(F.lit(0)))
    d = d.withColumn("__sure", F.least(F.greatest(F.col("__near") - F.col("__width"), F.lit(0)), F.col(most)))
    d = d.withColumn("__open", F.col(seats) - F.sum("__sure").over(g))
    last = F.least(F.col("__near") + F.col("__width"), F.col(most)) - 1
    cand = d.filter(F.col(weight) > 0).withColumn("__last", last).filter("__last >= __sure").withColumn("__k", F.explode(F.sequence("__sure", "__last")))
    rank = F.row_number().over(g.orderBy((F.col(weight) / (2 * F.col("__k") + 1)).desc(), F.col(key).asc_nulls_last(), "__k"))
    keys = list(dict.fromkeys([*group, key]))
    won = cand.withColumn("__rank", rank).filter("__rank <= __open").groupBy(*keys).agg(F.count(F.lit(1)).alias("__won"))
    left, right = d.alias("a"), won.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond &= c
    out = left.join(right, cond, "left")
    return out.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a.__sure") + F.coalesce(F.col("b.__won"), F.lit(0))).alias("quota"))


def mix(docs: DataFrame, seed: int = 1, weights=WEIGHTS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, region: int = REGION, keep_text: bool = True) -> DataFrame:
    """docs with __size, __source_size, __target, __taken and __block (what copies() needs); the columns of docs stay.

    Null text has size 0; a null source is a source of its own, last. Repeated rows are documents of their own. The
    mix takes each word of a block as often as the block; no more than MOST_COPIES times. Names that begin with two
    underscores are the operator's own; any other columns of docs pass. Without keep_text the text isn't among them.
    """
    kept = [c for c in docs.columns if keep_text or c != "text"]
    key = F.col("doc_id").cast("string")
    sized = written(docs.select(*kept, n_words(F.col("text")).alias("__size"), F.xxhash64(F.lit(seed), key, "text").alias("__order"), F.xxhash64(F.lit(seed + 1), key, "text").alias("__spread")), "mix-sizes")
    per_source = written(sized.groupBy("source").agg(F.sum("__size").alias("source_size")), "mix-sources")
    total = per_source.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    # by the source's own size, so that a cell is many blocks or the whole source
    shards = per_source.select(F.col("source").alias("__own"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("__shards"))
    sized = sized.join(shards, F.col("source").eqNullSafe(F.col("__own")))
    sized = sized.withColumn("__shard", F.pmod("__spread", F.col("__shards"))).drop("__own", "__shards", "__spread")
    cells = written(sized.groupBy("source", "__shard").agg(F.sum("__size").alias("cell")), "mix-cells")
    cells = cells.withColumn("blocks", F.when(F.col("cell") > 0, F.greatest(F.lit(1), F.round(F.col("cell") / block_words).cast("long"))).otherwise(F.lit(0)))
    cells = cells.withColumn("region", _div(F.col("__shard"), F.lit(region)))
    sources = targets(per_source, weights).withColumnRenamed("source", "s")
    regions = written(cells.groupBy("source", "region").agg((F.sum("blocks") * MOST_COPIES).alias("most"), F.sum("cell").cast("double").alias("weight")), "mix-regions")
    held = regions.groupBy("source").agg(F.sum("most").alias("most"))
    sources = sources.join(held, F.col("s").eqNullSafe(held["source"])).withColumn("seats", F.round(F.lit(total) / block_words).cast("long"))
    sources = written(apportion(sources.drop("source"), [], "s", "target", "seats", "most").select("s", "source_size", "target", F.col("quota").alias("source_quota")), "mix-quotas")
    regions = regions.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    regions = apportion(regions, ["source"], "region", "weight", "source_quota", "most").select(F.col("source").alias("s"), F.col("region").alias("r"), "source_size", "target", F.col("quota").alias("region_quota"))
    cells = cells.join(written(regions, "mix-regions"), F.col("source").eqNullSafe(F.col("s")) & (F.col("region") == F.col("r"))).drop("s", "r").withColumn("most", F.col("blocks") * MOST_COPIES).withColumn("weight", F.col("cell").cast("double"))
    plan = apportion(cells, ["source", "region"], "__shard", "weight", "region_quota", "most")
    plan = written(plan.select(F.col("source").alias("__s"), F.col("__shard").alias("__h"), *[F.col(c).alias(f"__{c}") for c in ("cell", "blocks", "quota")], F.col("source_size").alias("__source_size"), F.col("target").alias("__target")), "mix-plan")
    order = Window.partitionBy("source", "__shard").orderBy("__order", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    run = sized.withColumn("__at", F.coalesce(F.sum("__size").over(order), F.lit(0)))
    run = run.join(plan, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__shard") == F.col("__h")))
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(F.xxhash64(F.lit(seed), "__s", "__h"), F.lit(len(PRIMES))) + 1).cast("int"))
    block = F.struct(F.col("__at").alias("at"), *[F.col(f"__{c}").alias(c) for c in ("cell", "blocks", "quota")], prime.alias("prime"), F.pmod(F.xxhash64("__h", F.lit(seed), "__s"), F.greatest("__blocks", F.lit(1))).alias("shift"))
    run = run.withColumn("__block", block)
    at, size, b = F.col("__at"), F.col("__size"), F.col("__block")
    j0, j1 = _block_of(at, b), _block_of(at + size - 1, b)
    taken = F.aggregate(F.sequence(j0, j1), F.lit(0).cast("long"), lambda acc, j: acc + _copies(j, b) * (F.least(at + size, _starts(j + 1, b)) - F.greatest(at, _starts(j, b))))
    run = run.withColumn("__taken", F.when(size > 0, taken).otherwise(F.lit(0).cast("long")))
    return run.select(*kept, "__size", "__source_size", "__target", "__taken", "__block")


def _div(a: Column, b: Column) -> Column:
    """The integer quotient of two longs that aren't negative."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def _block_of(word: Column, b: Column) -> Column:
    """The block that the run's word lies in; integers only."""
    return _div(word * b["blocks"], b["cell"])


def _starts(j: Column, b: Column) -> Column:
    """The first word of block j."""
    return _div(j * b["cell"] + b["blocks"] - 1, b["blocks"])


def _copies(j: Column, b: Column) -> Column:
    """How often block j is taken; the seeded permutation j -> (j + shift) * prime mod blocks picks those taken once more."""
    once_more = F.pmod((j + b["shift"]) * b["prime"], b["blocks"]) < F.pmod(b["quota"], b["blocks"])
    return _div(b["quota"], b["blocks"]) + once_more.cast("long")


def copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix as documents: a row with the words taken at least once, one with those taken twice or more, and so on.

    The words keep their white space; a document of which nothing is taken has no row.
    """
    b, at = F.col("__block"), F.col("__block.at")
    times = F.transform(F.sequence(_block_of(at, b), _block_of(at + F.col("__size") - 1, b)), lambda j: _copies(j, b))
    m = mixed.filter("__taken > 0").withColumn("__first", _block_of(at, b)).withColumn("__times", times)
    m = m.withColumn("__level", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max("__times"))))
    parts = F.regexp_extract_all("text", F.lit(WORD_WITH_SPACE), F.lit(1))
    chosen = F.filter(parts, lambda w, i: F.get(F.col("__times"), (_block_of(at + i, b) - F.col("__first")).cast("int")) >= F.col("__level"))
    text = F.when(F.array_min("__times") >= F.col("__level"), F.col("text")).otherwise(F.concat_ws("", chosen))
    m = m.withColumn("text", text)
    return m.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns) if "n_chars" in columns else m.select(*columns)
