import heapq
import random

from pyspark.sql import functions as F

from sealwright.llm import source_mixing as m

from .conftest import odd_texts, sentence


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: m.WEIGHTS[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        unit = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if unit * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else unit * weight[s] for s in names}
        capped |= over


def test_apportionment_is_that_of_the_highest_quotients(spark):
    rng = random.Random(3)
    for n, seats in ((1, 7), (5, 0), (12, 100), (40, 1000), (9, 3)):
        weights = [rng.choice([0.0, 1.0, rng.random() * 100]) for _ in range(n)]
        df = spark.createDataFrame([(f"k{i:02}", w, seats, 10**9) for i, w in enumerate(weights)], "k string, w double, seats long, most long")
        got = {r["k"]: r["quota"] for r in m.apportion(df, [], "k", "w", "seats", "most").collect()}
        want = {f"k{i:02}": 0 for i in range(n)}
        heap = [(-w, f"k{i:02}", w) for i, w in enumerate(weights) if w > 0]
        heapq.heapify(heap)
        for _ in range(seats if heap else 0):
            _, k, w = heapq.heappop(heap)
            want[k] += 1
            heapq.heappush(heap, (-w / (2 * want[k] + 1), k, w))
        assert got == want


def test_mix(spark, make, rng):
    rows = [(i, x, "odd") for i, x in enumerate(odd_texts(rng))]
    rows += [(100 + i, sentence(rng, rng.randrange(20, 400)), rng.choice(["hot", "hot", "hot", "b", "c", "d", None])) for i in range(400)]
    rows += [(900, "same words here", "b")] * 3 + [(None, "no id at all", None), (901, None, None), (902, "", "empty")]
    docs = make(rows)
    df = m.mix(docs, shard_words=20_000)
    got = [r.asDict() for r in df.select("doc_id", "source", "text", "__size", "__source_size", "__target", "__taken").collect()]
    assert len(got) == len(rows)
    import re

    sizes, taken = {}, {}
    for r in got:
        assert r["__size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert 0 <= r["__taken"] <= 3 * r["__size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["__size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["__taken"]
    want = brute_targets(sizes)
    for r in got:
        assert r["__source_size"] == sizes[r["source"]] and abs(r["__target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.03 * want[s], 3 * m.BLOCK_WORDS)
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["__taken"])
    again = [r.asDict() for r in m.mix(docs.repartition(7), shard_words=20_000).select("doc_id", "source", "text", "__size", "__source_size", "__target", "__taken").collect()]
    assert sorted(map(key, got)) == sorted(map(key, again))
    # the mix as documents has just the words taken
    out = m.copies(df, docs.columns)
    assert out.columns == docs.columns
    words = {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(m.n_words(F.col("text")))).collect()}
    assert words == {s: n for s, n in taken.items() if n}
    per_doc = {r[0]: r[1] for r in out.groupBy("doc_id").agg(F.sum(m.n_words(F.col("text")))).collect()}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 900:
            assert per_doc.get(r["doc_id"], 0) == r["__taken"]
    assert out.filter(F.col("doc_id") == 3).count() <= 3


def test_small_source_beside_a_large_one(spark, make, rng):
    """A small source of short documents gets its target however many shards the large one has."""
    rows = [(i, sentence(rng, 400), "z large") for i in range(500)] + [(1000 + i, sentence(rng, 10), "small") for i in range(200)]
    got = {r[0]: (r[1], r[2]) for r in m.mix(make(rows), shard_words=2_000).groupBy("source").agg(F.max("__target"), F.sum("__taken")).collect()}
    for target, taken in got.values():
        assert abs(taken - target) <= max(0.03 * target, 3 * m.BLOCK_WORDS)
    assert got["small"][0] == 6000


def test_regions_and_clashing_names(spark, make, rng):
    """Quotas by way of regions of two shards; a table may have any of the operator's plain names."""
    rows = [(i, sentence(rng, rng.randrange(100)), rng.choice("aab")) for i in range(300)]
    docs = make(rows).select("*", *[F.lit("mine").alias(c) for c in ("cell", "blocks", "quota", "source_size", "target", "region", "most", "weight", "seats", "s", "source_quota", "taken")])
    mixed = m.mix(docs, shard_words=1500, region=2)
    assert mixed.columns[: len(docs.columns)] == docs.columns
    for target, taken in (tuple(r)[1:] for r in mixed.groupBy("source").agg(F.max("__target"), F.sum("__taken")).collect()):
        assert abs(taken - target) <= max(0.03 * target, 3 * m.BLOCK_WORDS)
    out = m.copies(mixed, docs.columns)
    assert out.columns == docs.columns and {r[0] for r in out.select("target").distinct().collect()} == {"mine"}
    short = m.mix(docs, keep_text=False)
    assert "text" not in short.columns and short.count() == 300


def test_empty_table(spark, make):
    assert m.mix(make([])).collect() == []
    assert m.mix(make([(1, None, "a"), (2, "", None)])).select("__taken").collect() == [(0,), (0,)]
