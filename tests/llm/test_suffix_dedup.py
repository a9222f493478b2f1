import hashlib
import random

import numpy as np
import pytest

from sealwright.llm import suffix_dedup as m

from .conftest import odd_texts, sentence


def brute(rows):
    big = 1 << 63
    raw = [(big if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for o, b in raw:
        for p in range(len(b) - m.LENGTH + 1):
            s = b[p : p + m.LENGTH]
            first[s] = min(first.get(s, o), o)
    out = []
    for (doc_id, _), (o, b) in zip(rows, raw):
        c = np.zeros(len(b), bool)
        for p in range(len(b) - m.LENGTH + 1):
            if first[b[p : p + m.LENGTH]] < o:
                c[p : p + m.LENGTH] = True
        spans = sum(bool(x) and not (i and c[i - 1]) for i, x in enumerate(c))
        kept = bytes(x for x, y in zip(b, c) if not y)
        out.append((doc_id, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 20, m.HOT), (4000, 6000, m.HOT), (4000, 6000, 3), (1 << 20, 3000, 0)])
def test_against_brute_force(spark, make, sizes, monkeypatch):
    """Large and small groups and buckets; beginnings compared by suffixes, and as hot ones by windows."""
    rng = random.Random(2)
    shared = [sentence(rng, n) for n in (8, 9, 10, 12, 30, 80)]
    rows = [(i, " ".join([sentence(rng, rng.randrange(20)), rng.choice(shared), sentence(rng, rng.randrange(6)), rng.choice(shared)])) for i in range(120)]
    rows += [(500 + i, rows[i % 7][1]) for i in range(30)]  # exact copies
    rows += [(600, "ab" * 400), (601, "ab" * 300 + "c"), (602, "b" + "ab" * 90), (603, "x" * 49), (604, "x" * 49), (605, "x" * 50), (606, "x" * 51), (607, "-" * 3000)]
    rows += [(700 + i, x) for i, x in enumerate(odd_texts(rng)) if len(x or "") < 6000]
    rows += [(None, rows[0][1]), (None, shared[5]), (None, "plumless " * 9), (None, "buckeroo " * 9), (9, "plumless"), (9, "buckeroo"), (8, rows[3][1]), (8, rows[3][1]), (8, "other " + rows[4][1])]
    rng.shuffle(rows)
    got = m.dedup(make(rows), group_bytes=sizes[0], bucket_bytes=sizes[1], hot=sizes[2]).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute(rows)
    for r in got:
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


@pytest.mark.parametrize("small", [1, 7, 4096])
def test_multikey_quicksort(small, monkeypatch):
    monkeypatch.setattr(m, "SMALL_SEGMENT", small)
    rng = np.random.default_rng(1)
    for width, n in ((1, 500), (2, 500), (5, 500), (3, 1), (3, 2)):
        keys = rng.integers(0, 3, (n, width)).astype(np.uint64)
        order, new = m.multikey_quicksort(n, width, lambda rows, depth: keys[rows, depth])
        rows = [tuple(r) for r in keys[order].tolist()]
        assert rows == sorted(map(tuple, keys.tolist()))
        assert new.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(len(rows))]


def test_words_of_strings():
    data = np.frombuffer(bytes(range(1, 31)) + bytes(8), np.uint8)
    for place in range(30):
        for left in range(-2, 31 - place):
            want = int.from_bytes(data[place : place + min(max(left, 0), 8)].tobytes().ljust(8, b"\0"), "big")
            assert int(m.word_at(data, np.array([place]), np.array([left]))[0]) == want


def test_windows_by_stretches(monkeypatch):
    """The suffixes of a group don't depend on how much of it is hashed at once, but for where contexts are cut."""
    import pyarrow as pa

    rng = random.Random(5)
    texts = [sentence(rng, n) for n in (3, 200, 40, 9)] + ["x" * 3000, "ab" * 500, "short"]
    group = m.Group(pa.table({"ord": list(range(len(texts))), "tag": [b"t"] * len(texts), "text": texts}))

    def windows():
        h, doc, at, n, off, lead = group.suffixes(np.empty(0, np.int64))
        assert n.max() <= m.MOST_WINDOWS
        return sorted((d, a + i) for d, a, k in zip(doc.tolist(), at.tolist(), n.tolist()) for i in range(k)), {(d, a + o): x for d, a, o, x in zip(doc.tolist(), at.tolist(), off.tolist(), h.tolist())}

    every, anchors = windows()
    assert every == [(d, p) for d, t in enumerate(texts) for p in range(len(t) - m.LENGTH + 1)]
    monkeypatch.setattr(m, "STRETCH", 700)
    cut, more = windows()
    assert cut == every and anchors.items() <= more.items() | anchors.items() and all(more[k] == v for k, v in anchors.items() if k in more)


def test_long_repetitions_need_little_memory():
    """A thousand long repetitions and a very long one in one bucket."""
    import tracemalloc

    import pyarrow as pa

    class Value:
        value = (np.empty(0, np.uint64), np.empty(0, np.uint64))

    texts = [("x" * 900 + f" tail {i} of this one") for i in range(1000)] + ["x" * 1_000_000]
    table = pa.table({"dest": [0] * len(texts), "ord": list(range(len(texts))), "tag": [str(i).encode() for i in range(len(texts))], "text": texts})
    none = pa.table({"ord": pa.array([], pa.int64()), "tag": pa.array([], pa.binary())})
    tracemalloc.start()
    found = m.extract(Value, 1)(table, none)
    found = m.find_shared(m.HOT)(found)
    found = m.contexts(Value, 1)(table, found)
    found = m.compare(found)
    rows = m.remove(False)(table.append_column("doc_id", table.column("ord")), found).to_pylist()
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    assert rows[0]["n_removed"] == 0 and rows[1]["n_removed"] >= 900 and rows[1000]["n_removed"] == 1_000_000


def test_empty_tables(spark, make):
    assert m.dedup(make([])).collect() == []
    assert [tuple(r)[1:4] for r in m.dedup(make([(1, None), (2, ""), (None, None)])).collect()] == [(0, 0, 0)] * 3


def test_what_a_group_sends_does_not_grow_with_the_buckets(rng):
    """2 MB of text dealt to one bucket and to 3,750, as at 30 GB: the blocks hold the same suffixes in much the same space."""
    import time

    import pyarrow as pa

    words = [("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10)))) for _ in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(160)) for _ in range(2100)]
    ids = sorted(rng.sample(range(10**9), len(texts)))
    table = pa.table({"dest": [0] * len(texts), "ord": ids, "tag": [str(i).encode() for i in ids], "text": texts})
    none = pa.table({"ord": pa.array([], pa.int64()), "tag": pa.array([], pa.binary())})
    h, _, _, _, _, lead = m.Group(table).suffixes(np.empty(0, np.int64))
    order = np.lexsort((h, lead))

    def sent(n_buckets):
        class Value:
            value = tuple(x[order][np.arange(1, n_buckets) * len(order) // n_buckets] for x in (lead, h))

        start = time.process_time()
        rows = [r for r in m.extract(Value, n_buckets)(table, none).to_pylist() if r["kind"] == "suffixes"]
        return rows, time.process_time() - start

    def suffixes(rows):
        import zstandard

        parts = [m.unpack_suffixes(zstandard.ZstdDecompressor().decompress(r["data"])) for r in rows]
        return sorted(zip(*(np.concatenate(c).tolist() for c in zip(*parts))))

    (one, base), (many, seconds) = sent(1), sent(3750)
    assert len(many) > 3000 and suffixes(one) == suffixes(many)
    size = sum(len(r["data"]) for r in many)
    assert size < 1.2 * sum(map(len, texts))
    assert seconds - base < 0.5


def test_buckets_by_splitters_with_equal_leads():
    rng = np.random.default_rng(3)
    splitters = sorted(zip(rng.integers(0, 9, 40).tolist(), rng.integers(0, 50, 40).tolist()))
    lead, h = (rng.integers(0, n, 500).astype(np.uint64) for n in (11, 50))
    got = m.bucket_of(lead, h, tuple(np.array(x, np.uint64) for x in zip(*splitters)))
    assert got.tolist() == [sum(x <= y for x in splitters) for y in zip(lead.tolist(), h.tolist())]
