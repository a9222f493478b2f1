import hashlib
import random
import zlib

import pytest

from sealwright.llm import conversation_trie as t


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            what = hashlib.md5(f"{len(role.encode())}:".encode() + (role + text).encode()).digest()
            by.setdefault(conv, []).append(((turn is not None, turn or 0, what), role, text))
    turns = {c: [(role, text) for _, role, text in sorted(x)] for c, x in by.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
    nodes, kids = {}, {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out, below = [], {}
    for k in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0)
        mine = kids.get(k, [])
        below[k] = (sum(below[x][0] for x in mine) or 1, own + sum(below[x][1] for x in mine))
        ends = ",".join(str(c) for c in sorted(nodes[k]) if len(built[c]) == len(k))
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(mine), *below[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def compare(spark, rows, **options):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("depth", "part", "a", "shard", "len")})
    got = sorted((tuple(r) for r in t.trie(df, **options).collect()), key=str)
    assert got == brute(rows)
    return got


def talk(rng, convs, most=9, pool="hi hello ok why because stone".split()):
    return [(c, i, rng.choice(["user", "assistant"]), " ".join(rng.choice(pool) for _ in range(rng.randrange(3)))) for c in convs for i in range(rng.randrange(1, most))]


@pytest.fixture()
def rng():
    return random.Random(11)


def test_against_brute_force(spark, rng):
    rows = talk(rng, range(250))
    rows += [(300, None, None, None), (300, None, None, None), (301, 1, None, "x"), (301, 1, "u", None), (301, 1, "u", ""), (302, 0, "é日本", "é日本"), (None, 1, "u", "lost")]
    rng.shuffle(rows)
    compare(spark, rows)


def test_turnless_conversations_end_at_the_root(spark):
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    got = compare(spark, [(alone, 0, "u", "x")])
    assert len(got) == 1 and got[0][:2] == (alone, 0) and got[0][7] == hashlib.sha256(str(alone).encode()).hexdigest()


def test_copies_and_hot_beginnings(spark, rng):
    same = [(i, "u", f"t{i}") for i in range(12)]
    rows = [(c, *x) for c in range(400, 520) for x in same]
    rows += [(c, i, "u", "hot" if i < 7 else f"{c}") for c in range(1000, 1150) for i in range(9)]
    compare(spark, rows + talk(rng, range(40)))


def test_a_long_conversation_in_parts(spark, rng):
    rows = [(777, i, "u", f"turn {i % 50}") for i in range(3000)] + talk(rng, range(60))
    compare(spark, rows)


def test_messages_spill(spark, rng):
    compare(spark, talk(rng, range(200)), queue=3)


def test_queue_orders_over_its_runs(tmp_path, rng, monkeypatch):
    monkeypatch.setattr(t, "attempt_name", lambda a, b: a + b)
    q = t.SpillingQueue(f"file://{tmp_path}", 10)
    keys, out = [], []
    for step in range(400):
        if rng.random() < 0.7 or not keys:
            k = (rng.randrange(50), 0, 0)
            keys.append(k)
            q.push(k, (step,))
        else:
            assert q.first() == min(keys)
            keys.remove(q.pop()[0])
    while q.first() is not None:
        out.append(q.pop()[0])
    assert out == sorted(keys) and q.spilled > 5 and not list(tmp_path.iterdir())


def test_no_conversations(spark):
    assert t.trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_blocks_of_ends(spark, monkeypatch):
    monkeypatch.setattr(t, "ENDS", 4)
    base = [(0, i, "u", f"t{i}") for i in range(6)]
    compare(spark, [(c, *x[1:]) for c in range(60) for x in base])
