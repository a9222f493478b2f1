import random
from itertools import combinations

import numpy as np
import pytest

from sealwright.llm import order_minhash as m

from .conftest import odd_texts, sentence


def word_list(text):
    return "".join(c.lower() if c.isalnum() else " " for c in text or "").split()


def brute_similarity(a, b):
    """1 - edits / words of the longer list, by the whole matrix."""
    if not a or not b:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        i = rng.randrange(len(w))
        w[i : i + rng.randrange(2)] = ["new" + str(rng.randrange(99))]
    return " ".join(w)


def test_alignment_is_exact_from_the_threshold_on():
    rng = random.Random(4)
    for k in range(1500):
        a = sentence(rng, rng.randrange(1, 60), "a b c d e f g")
        b = edited(rng, a, rng.randrange(1 + len(a) // 4)) if rng.random() < 0.8 else sentence(rng, rng.randrange(1, 60), "a b c")
        x, y = a.split(), b.split()
        least = (0.8, 0.5, 0.0)[k % 3]
        got, want = m.similarity(x, y, least), brute_similarity(x, y)
        assert abs(got - want) < 1e-12 if want >= least else got < least
    x = [rng.randrange(1000) for _ in range(20_000)]
    y = x[:7] + [-1] * 30 + x[9:5000] + x[5100:] + [-2] * 50
    assert m.edit_distance(x, y, 4000) == 30 + 100 + 50


def test_sketches_follow_order_and_occurrences():
    h = np.arange(100, 160, dtype=np.int64) * 7919
    one = m.sketches(m.shingles(h))
    assert (one == m.sketches(m.shingles(h))).all()
    assert (one != m.sketches(m.shingles(h[::-1].copy()))).all()
    twice = m.shingles(np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 5], np.int64))
    assert len(set(twice.tolist())) == len(twice)
    long = np.random.default_rng(0).integers(0, 1 << 62, 200_000)
    assert len(m.sketches(m.shingles(long))) == m.TABLES


@pytest.mark.parametrize("parts", [2, 9])
def test_against_brute_force(spark, make, parts):
    rng = random.Random(6)
    base = [sentence(rng, rng.choice([30, 60, 150])) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(25, 110):
        rows.append((i, edited(rng, rng.choice(base[:10]), rng.choice([0, 1, 1, 2, 9]))))
    hot = sentence(rng, 120)
    rows += [(200 + i, edited(rng, hot, 1)) for i in range(60)]
    rows += [(300 + i, hot[:200] + sentence(rng, 60)) for i in range(20)]  # a shared passage alone is no near duplicate
    rows += [(400 + i, x) for i, x in enumerate(odd_texts(rng)) if len(x or "") < 6000]
    rows += [(500, "one two"), (501, "ONE, two!"), (502, "one two three"), (None, rows[0][1]), (503, None), (504, ""), (9, rows[9][1])]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(r) for r in m.near_duplicates(make(rows)).collect()]
        kept = sorted((r["doc_id"] for r in m.drop_near_duplicates(make(rows)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    # links by all pairs
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    lists, links = [word_list(t) for _, t in rows], []
    for i, j in combinations(range(len(rows)), 2):
        if min(len(lists[i]), len(lists[j])) >= 0.8 * max(len(lists[i]), len(lists[j])) and (x := m.similarity(lists[i], lists[j])) >= m.SIMILARITY:
            links.append((x, i, j))
            root[find(i)] = find(j)
    out = {}
    for d, c in got:
        out.setdefault(d, []).append(c)
    # no class goes beyond the links, whatever was found of them; texts without words are alone
    smallest: dict = {}
    for i, (d, _) in enumerate(rows):
        smallest.setdefault(find(i), []).append(d)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            assert all(c == d or c in smallest[find(i)] and lists[i] for c in out[d])
    assert sum(map(len, out.values())) == len(rows)
    # nearly all links are in one class, as are all of very similar texts
    one = {d: c[0] for d, c in out.items()}
    ids = lambda i: one[rows[i][0]]
    same = [(x, ids(i) == ids(j)) for x, i, j in links if rows[i][0] is not None and rows[j][0] is not None]
    assert len(same) > 1000 and sum(y for _, y in same) >= 0.99 * len(same) and all(y for x, y in same if x >= 0.93)
    assert one[500] == one[501] == 500 and one[502] == 502 and one[503] == 503
    assert kept == sorted({d for d, c in got if d == c}, key=repr)


def test_recall_of_edited_copies(spark, make):
    """Copies with one word in 50, 20, 12 and 8 replaced, dropped or added: at least 0.9 of them are with their original."""
    rng = random.Random(21)
    pool = [f"w{i}" for i in range(4000)]
    rows, pairs = [], []
    for k in range(200):
        text = [rng.choice(pool) for _ in range(rng.choice([25, 60, 200]))]
        w = list(text)
        for _ in range(max(1, len(w) // (50, 20, 12, 8)[k % 4])):
            i = rng.randrange(len(w))
            w[i : i + rng.randrange(2)] = [rng.choice(pool)] * rng.randrange(2)
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(w))]
        pairs.append(m.similarity(text, w) >= m.SIMILARITY)
    got = {r["doc_id"]: r["class_id"] for r in m.near_duplicates(make(rows)).collect()}
    found = [got[2 * k + 1] == 2 * k for k in range(200)]
    assert sum(pairs) > 190 and sum(f for f, p in zip(found, pairs) if p) >= 0.95 * sum(pairs)
    assert all(got[2 * k] == 2 * k for k in range(200))


def test_star_of_copies(spark, make):
    """1,000 copies, each with a stretch of words of its own: similar to the original, but seldom to each other."""
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(3000)]
    original = [rng.choice(pool) for _ in range(120)]
    texts = [" ".join(original)]
    for i in range(1000):
        w = list(original)
        a = rng.randrange(100)
        w[a : a + 20] = [f"x{i}y{j}" for j in range(20)]
        texts.append(" ".join(w))
    # one part is the same in all of these, the rest never: they share runs, and are no near duplicates
    texts += [" ".join(original[:90] + [f"z{i}x{j}" for j in range(30)]) for i in range(40)]
    lists = [t.split() for t in texts]
    assert all(brute_similarity(lists[0], x) >= m.SIMILARITY for x in lists[1:1001:50])
    for i in range(1001, len(texts)):
        assert max(m.similarity(lists[i], lists[j]) for j in [0, *range(1001, len(texts))] if j != i) < m.SIMILARITY
    root = [0] * 1001 + list(range(1001, len(texts)))
    for i in range(1001, len(texts)):  # a copy whose own stretch lies in the unlike part may be similar to these
        if any(m.similarity(lists[i], x) >= m.SIMILARITY for x in lists[1:1001]):
            root[i] = 0
    got = {r["doc_id"]: r["class_id"] for r in m.near_duplicates(make(list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(root))


def test_signatures_never_rule_out_what_is_similar():
    rng = random.Random(9)
    for n in (1, 7, 60, 3000):
        for _ in range(20):
            w = [rng.randrange(1 << 40) for _ in range(n)]
            v = list(w)
            for _ in range(rng.randrange(1 + n // 40)):
                at = rng.randrange(n)
                v[at : at + rng.randrange(2)] = [rng.randrange(1 << 40)]
            if m.similarity(w, v) >= m.SIMILARITY:
                assert m.may_be_similar(m.labelled_words(np.array(w, np.int64)), m.labelled_words(np.array(v, np.int64)))
            x, y = m.signature(np.array(w, np.int64)), m.signature(np.array(v, np.int64))
            differ = sum(bin(int(p) & (1 << 64) - 1 ^ int(q) & (1 << 64) - 1).count("1") for p, q in zip(x[1:], y[1:]))
            assert len(x) == 1 + m.WORDS and x[0] == n and differ <= 2 * m.edit_distance(w, v, 2 * n) - abs(len(v) - n)


def test_larger_signatures_never_rule_out_what_is_similar():
    """Signatures grow with the text, and larger ones are folded for the comparison with smaller ones."""
    rng = random.Random(10)
    for n in (125, 260, 1030, 5000):
        for _ in range(20):
            w = [rng.randrange(1 << 40) for _ in range(n)]
            v = list(w)
            for _ in range(rng.randrange(1 + n // 8)):
                at = rng.randrange(len(v))
                v[at : at + rng.randrange(2)] = [rng.randrange(1 << 40)] * rng.randrange(2)
            x, y = (m.signature(np.array(z, np.int64), m.signature_words(len(z)))[None] for z in (w, v))
            size = min(x.shape[1], y.shape[1]) - 1
            assert m.WORDS <= size <= m.MOST_WORDS
            a, b = m.folded(x[:, 1:], size), m.folded(y[:, 1:], size)
            assert (a == m.signature(np.array(w, np.int64), size)[1:]).all()
            assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= 2 * m.edit_distance(w, v, 2 * n) - abs(len(v) - n)


@pytest.mark.parametrize("tile", [7, 1024])
def test_pairs_of_a_large_group_that_is_not_similar(spark, make, monkeypatch, tile):
    """300 texts that share a bit less than is enough, and three similar pairs of them: nearly no pair becomes a row."""
    rng = random.Random(12)
    shared = [f"s{i}" for i in range(560)]
    texts = [shared + [f"o{i}x{j}" for j in range(200)] for i in range(300)]
    for i in (0, 100, 200):  # what an alignment finds: 130 of the own words are another's
        texts[i + 1] = texts[i][:690] + [f"p{i}x{j}" for j in range(70)]
    assert [m.similarity(texts[i], texts[i + 1]) >= m.SIMILARITY for i in (0, 100, 200, 5)] == [True, True, True, False]
    monkeypatch.setattr(m, "TILE", tile)
    rows, plain = [], m.verified

    def counted(pairs, *args):
        rows.append(pairs.count())
        return plain(pairs, *args)

    monkeypatch.setattr(m, "verified", counted)
    got = {r["doc_id"]: r["class_id"] for r in m.near_duplicates(make([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert got == {i: i - (i in (1, 101, 201)) for i in range(300)}
    assert len(rows) > 1 and sum(rows[1:]) <= 300


@pytest.mark.parametrize("at_a_time", [1, 7, 1 << 17])
def test_closure_of_a_long_chain(spark, monkeypatch, at_a_time):
    monkeypatch.setattr(m, "LINKS", at_a_time)
    links = [(i.to_bytes(16, "big"), (i + 1).to_bytes(16, "big")) for i in range(40)] + [(b"x" * 16, b"y" * 16)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in links], "a binary, b binary, similarity double")
    got = {bytes(r["node"]): bytes(r["root"]) for r in m.classes(df).collect()}
    assert got == {i.to_bytes(16, "big"): bytes(16) for i in range(1, 41)} | {b"y" * 16: b"x" * 16}


def test_empty_table(spark, make):
    assert m.near_duplicates(make([])).collect() == []
    assert m.drop_near_duplicates(make([])).collect() == []
