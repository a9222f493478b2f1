import itertools
import random

import pytest

from sealwright.llm import decontamination as m

from .conftest import odd_texts, sentence

ITEMS = "item_id long, text string"


def test_masks_find_any_two_substitutions_in_ten_words():
    for bad in itertools.combinations(range(10), 2):
        assert any(all(s + i not in bad for i, c in enumerate(mask) if c == "1") for mask in m.MASKS for s in range(10 - len(mask) + 1))


def test_short_masks_find_any_substitution_in_five_words():
    for bad in range(5):
        assert any(all(s + i != bad for i, c in enumerate(mask) if c == "1") for mask in m.SHORT_MASKS for s in range(5 - len(mask) + 1))


def brute(doc, item):
    """The best verified overlap's matches, over all places."""
    d, i = ("".join(c.lower() if c.isalnum() else " " for c in x or "").split() for x in (doc, item))
    if not i:
        return 0
    size = min(m.MIN_WORDS, len(i))
    best = max((sum(d[a + k] == i[b + k] for k in range(size)) for a in range(len(d) - size + 1) for b in range(len(i) - size + 1)), default=0)
    return best if best >= m.SIMILARITY * size - 1e-9 else 0


@pytest.mark.parametrize("hot", [16, 0])
def test_against_brute_force(spark, make, hot, monkeypatch):
    """Also with each seed extended that an item has."""
    monkeypatch.setattr(m, "HOT_PLACES", hot)
    rng = random.Random(11)
    items = [(i, sentence(rng, rng.choice([5, 6, 7, 8, 9, 10, 11, 15, 30]))) for i in range(24)] + [(50, "few distinctword"), (51, None), (53, "one"), (54, "Few, distinctword; two three"), (52, ""), (None, sentence(rng, 20))]
    docs = []
    for k in range(300):
        words, item = sentence(rng, rng.randrange(0, 60)).split(), rng.choice(items[:24])[1].split()
        part = item[rng.randrange(3) if len(item) > 9 else 0 :][: rng.choice([9, 13, 40])]
        for _ in range(rng.randrange(5 if len(item) > 9 else 3)):
            part[rng.randrange(len(part))] = rng.choice(["changed", "other"])
        at = rng.randrange(len(words) + 1)
        docs.append((k, " ".join(words[:at] + (part if k % 3 else []) + words[at:]).upper()))
    docs += [(1000 + i, x) for i, x in enumerate(odd_texts(rng)) if len(x or "") < 1000] + [(None, items[0][1]), (7, items[1][1]), (7, items[1][1])]
    docs += [(2000, "a few Distinctword b"), (2001, "few changed distinctword"), (2002, "a few distinctword two three b"), (2003, "one")]
    want = sorted(((d, i, n) for d, text in docs for i, item in items if (n := brute(text, item))), key=repr)
    bench = spark.createDataFrame(items, ITEMS)
    got = sorted(((r["doc_id"], r["item_id"], r["n_matches"]) for r in m.contaminated(make(docs), bench).collect()), key=repr)
    assert got == want and len(want) > 30
    clean = [d for d, text in docs if not any(brute(text, item) for _, item in items)]
    kept = m.decontaminate(make(docs), bench)
    assert kept.columns == make(docs).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(clean, key=repr)


def test_a_run_that_agrees_has_one_of_the_keys_that_are_enough():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.choice([6, 7, 9, 10, 12, 13, 14, 30])
        size, misses = m.run_and_misses(n)
        start = rng.randrange(n - size + 1)
        bad = set(rng.sample(range(start, start + size), misses))
        whole = [(mask, p) for mask in m.masks_of(n) for p in range(start, start + size - len(mask) + 1) if not any(c == "1" and p + i in bad for i, c in enumerate(mask))]
        assert whole
        for mask, p in whole:
            found = [(rng.randrange(5), d, d) for d in m.distances(mask) if 0 <= p + d < n]
            assert any(start <= p + d < start + size and p + d not in bad for d in m.enough(n, p, len(mask), found))


def test_a_phrase_that_many_share_makes_no_pairs_of_all(spark, make, monkeypatch):
    """Items and documents that share ten words and no more are hardly paired; the true overlaps are all there."""
    rng, pairs, n = random.Random(8), [], 250

    def own(k):
        return " ".join(f"w{rng.randrange(10**9)}" for _ in range(k))

    phrase = "which of the following statements is the most likely reason"
    assert len(phrase.split()) == 10
    items = [(i, f"{own(4)} {phrase} {own(8)}") for i in range(n)]
    docs = [(i, f"{own(20)} {phrase} {own(20)}") for i in range(n)] + [(n + i, f"{own(5)} {items[i][1]}") for i in range(5)]
    write = m.written

    def counted(df, name):
        out = write(df, name)
        if name == "seed-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(m, "written", counted)
    got = sorted((r["doc_id"], r["item_id"]) for r in m.contaminated(make(docs), spark.createDataFrame(items, ITEMS)).collect())
    assert got == [(n + i, i) for i in range(5)]
    assert pairs[0] <= 2 * len(got)


def test_a_full_bitmap_gives_the_same(spark, make, rng, monkeypatch):
    """A bitmap too small for the benchmark drops fewer seeds, and nothing else."""
    items = [(i, sentence(rng, 20)) for i in range(20)]
    docs, bench = make([(i, f"x {t} y") for i, t in items] * 2), spark.createDataFrame(items, ITEMS)
    one = sorted(map(tuple, m.contaminated(docs, bench).collect()))
    assert len(one) >= 40
    monkeypatch.setattr(m, "MOST_BITS", 64)
    monkeypatch.setattr(m, "PARTS", 2)
    assert sorted(map(tuple, m.contaminated(docs, bench).collect())) == one
    assert m.decontaminate(docs, bench).count() == 0


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], ITEMS)
    assert m.contaminated(make([(1, "some text")]), none).collect() == []
    assert m.contaminated(make([]), none).collect() == []
    assert m.decontaminate(make([(1, None), (2, "a")]), none).count() == 2
