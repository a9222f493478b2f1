import hashlib
import math
import re
import zlib

import numpy as np

from sealwright.llm import resampling as r

from .conftest import odd_texts, sentence

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, max_run):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[i : i + n]).encode() for n in range(1, max_run + 1) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, o):
    b = o.buckets
    s, t = [0] * b, [0] * b
    found = [features(x, o.max_run) for _, x in docs]
    for fs, _ in found:
        for f in fs:
            s[zlib.crc32(f) % b] += 1
    for x in target:
        for f in features(x, o.max_run)[0]:
            t[zlib.crc32(f) % b] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + b) / ((s[i] + 1) * (sum(t) + b)))) for i in range(b)]
    rows = []
    for (doc_id, _), (fs, words) in zip(docs, found):
        h = int(hashlib.sha256(f"{o.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f) % b] for f in fs)
        rows.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    can = sorted((x for x in rows if x[5] >= o.least_words), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for i in range(o.percent * len(can) // 100):
        can[i][4] = i + 1
    return sorted((tuple(x[:5]) for x in rows), key=str)


def compare(spark, make, docs, target, o=r.Resampling()):
    items = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = sorted((tuple(x) for x in r.resample(make(docs), items, o).collect()), key=str)
    assert got == brute(docs, target, o)
    return got


def test_against_brute_force(spark, make, rng):
    docs = list(enumerate(odd_texts(rng))) + [(100 + i, sentence(rng, rng.randrange(60))) for i in range(300)]
    docs += [(None, sentence(rng, 30)), (7, "AİK " * 30), (3, None)]
    got = compare(spark, make, docs, [sentence(rng, 20), None, "", "stone river"])
    assert sum(x[4] is not None for x in got) == 10 * sum(features(t, 1)[1] >= 20 for _, t in docs) // 100


def test_runs_of_words_and_other_parameters(spark, make, rng):
    docs = [(i, sentence(rng, rng.randrange(50))) for i in range(80)]
    compare(spark, make, docs, [sentence(rng, 30)], r.Resampling(buckets=97, max_run=3, seed=5, least_words=8, percent=37))


def test_ties_and_repeated_rows_have_their_own_ranks(spark, make, rng):
    text = sentence(rng, 25)
    got = compare(spark, make, [(5, text)] * 300 + [(i, sentence(rng, 25)) for i in range(100)], [text])
    assert sorted(x[4] for x in got if x[4]) == list(range(1, 41))


def test_empty_tables(spark, make):
    compare(spark, make, [], ["a b"])
    compare(spark, make, [(1, "a " * 30)], [])


def test_ranks_of_large_runs(spark, monkeypatch):
    """Hot values, more samples than the driver takes, and no range above about twice its share."""
    monkeypatch.setattr(r, "SAMPLES", 40)
    n = 5000
    rows = spark.range(n, numPartitions=13).selectExpr("case when id % 3 = 0 then 7 else id * 7919 % 1000 end as down", "case when id % 3 = 0 then 1 else id end as doc_id")
    runs = r.sorted_runs(rows)
    got = r.ranked(runs, 1234, 6).orderBy("rank").collect()
    ranks = [x for x in got if x["rank"] is not None]
    want = sorted(((x["down"], x["doc_id"]) for x in rows.collect()))
    assert [x["rank"] for x in ranks] == list(range(1, 1235))
    assert [(x["down"], x["doc_id"]) for x in ranks] == want[:1234] and len(got) == n
    monkeypatch.setattr(r, "SAMPLES", 100_000)
    cuts = r.splitters(runs, 6)
    keys = sorted((x["down"], 1, x["doc_id"], x["place"]) for x in runs.collect())
    import bisect

    sizes = np.diff([0, *(bisect.bisect_left(keys, c) for c in cuts), n])
    assert len(sizes) == 6 and sizes.max() <= 2 * n / 6 + 13
