import hashlib
import json
import random

import numpy as np
import pytest

from sealwright.llm import bpe, token_output

from .conftest import odd_texts, sentence

PATH = token_output.tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def same(codec, library, texts):
    got, want = codec.encode(texts), library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for t, ids, w in zip(texts, got, want):
        assert np.frombuffer(ids, "<u4").tolist() == w.ids, t[:50]
        assert codec.decode(ids) == library.decode(w.ids, skip_special_tokens=False)


def test_equal_to_the_library(library):
    rng = random.Random(1)
    codec = bpe.Codec(PATH)
    pool = [t.replace("</w>", "") for t in codec.merges.vocab if t.isascii()]
    texts = odd_texts(rng) + ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(8000)]
    texts += ["".join(rng.choice("ab'<|>.,é中́\x1c\x00 \n\x85　Aİß9²") for _ in range(rng.randrange(1, 40))) for _ in range(8000)]
    texts += ["aaaa" * n for n in range(1, 40)] + ["hahaha" * 50, "ab" * 700, "<|endoftext|>a<|startoftext|>", "e<|endoftext|>́"]
    same(codec, library, texts)
    # some words fail the check and are merged; most aren't
    assert 0 < codec.merged < codec.seen


def test_only_failing_words_are_merged(monkeypatch, library):
    codec = bpe.Codec(PATH)
    merged = []
    plain = codec.merges.merge
    monkeypatch.setattr(codec.merges, "merge", lambda piece: merged.append(piece) or plain(piece))
    words = [t[:-4] for t in codec.merges.vocab if t.endswith("</w>") and t.isascii() and t[:-4].isalpha()][:5000]
    same(codec, library, [" ".join(words)])
    assert merged == []  # each is a token, so its longest match is the whole of it


def test_longest_matches_look_at_few_lengths(library):
    """Only lengths that tokens with the same beginning have are tried, and the matches are those of all lengths."""
    merges = bpe.Codec(PATH).merges
    rng = random.Random(5)
    pieces = ["".join(rng.choice(["th", "on", "er", "ble", "e", "q", "Ã©", "ing", "'", "7"]) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]

    def every_length(piece):
        out, at, n = [], 0, len(piece)
        while at < n:
            if (found := merges.last.get(piece[at:])) is not None:
                return [*out, found]
            stop = next(stop for stop in range(n - 1, at, -1) if piece[at:stop] in merges.inner)
            out.append(merges.inner[piece[at:stop]])
            at = stop
        return out

    want, tried = [every_length(p) for p in pieces], []

    class Counted(dict):
        def get(self, *args):
            tried.append(args)
            return super().get(*args)

    merges.inner = Counted(merges.inner)
    assert [merges.propose(p) for p in pieces] == want
    assert len(tried) <= 4 * sum(map(len, want))


def test_latin_letters_need_no_library_call(library, monkeypatch):
    """Words of ASCII and Latin-1 letters are cut here, as the library cuts them; others go to it."""
    codec = bpe.Codec(PATH)
    rng = random.Random(6)
    letters = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
    texts = [" ".join("".join(rng.choice(letters + list("abLZ'.9<|>")) for _ in range(rng.randrange(1, 12))) for _ in range(50)) for _ in range(200)]
    monkeypatch.setattr(codec, "normalize", None)
    same(codec, library, texts + ["".join(letters), *letters])
    with pytest.raises(TypeError):
        codec.pieces("a×b")


def test_pairs_are_judged_as_merging_does():
    merges = bpe.Merges({c: i for i, c in enumerate(["a", "b", "c", "ab", "bc", "aa", "abc", "abab"])}, ["a b", "b c", "a a", "ab c", "ab ab"], "")
    rng = random.Random(4)
    pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    assert merges.encode(pieces)[0] == [merges.merge(p) for p in pieces]
    symbols = [[merges.vocab[c] for c in p] for p in pieces]
    assert [merges._merge_long(list(x)) for x in symbols] == [merges._merge_short(list(x)) for x in symbols]
    assert not merges.apart(np.array([0]), np.array([5]))[0] and merges.apart(np.array([5]), np.array([0]))[0]  # aaa is aa, a


def test_words_forgotten_and_met_again(library):
    rng = random.Random(2)
    codec = bpe.Codec(PATH, most=50)
    for _ in range(30):
        same(codec, library, [sentence(rng, 40) + "x" * rng.randrange(9) for _ in range(5)])


def test_other_tokenizers_are_refused(tmp_path):
    spec = json.load(open(PATH))
    spec["normalizer"] = None
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Codec(str(tmp_path / "t.json"))


def test_query(spark, make, rng, library, tmp_path):
    from pyspark.sql import functions as F

    from sealwright.llm import queries

    rows = list(enumerate(odd_texts(rng))) + [(None, "no id"), (3, "twice"), (3, "twice")]
    make(rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in queries.op11_bpe(spark, f"file://{tmp_path}").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    apart = make(rows).select("doc_id", bpe.encoded(F.col("text"), PATH).alias("i")).withColumn("t", bpe.decoded(F.col("i"), PATH))
    assert sorted(((r.doc_id, len(r.i) // 4, hashlib.sha256(bytes(r.i)).hexdigest(), hashlib.sha256(r.t.encode()).hexdigest()) for r in apart.collect()), key=str) == sorted(want, key=str)
    docs = bpe.encode_and_decode(make(rows[:4]), PATH)
    assert "size" in docs.columns and docs.count() == 4
    assert bpe.encode_and_decode(make([]), PATH).collect() == []


def test_a_batch_is_worked_off_in_parts(library, monkeypatch, rng):
    """An Arrow batch is a task's whole share: no more than a part of it is held as texts, ids and decoded texts."""
    import pyarrow as pa

    from sealwright.llm import shared

    texts, held, codec = [sentence(rng, 60) for _ in range(300)] + [None, sentence(rng, 3000), ""], [], bpe.Codec(PATH)
    plain = codec.encode
    monkeypatch.setattr(codec, "encode", lambda part: held.append(part) or plain(part))
    monkeypatch.setattr(bpe, "codec", lambda path: codec)
    monkeypatch.setattr(shared, "PIECE_BYTES", 10_000)
    out = [r for part in bpe.ids_and_texts(iter([pa.array(texts), pa.array([], pa.string())]), PATH) for r in part.to_pylist()]
    assert [t for part in held for t in part] == texts
    assert all(len(part) == 1 or sum(len(t or "") for t in part) <= 10_000 for part in held)
    for t, r, w in zip(texts, out, library.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        assert np.frombuffer(r["ids"], "<u4").tolist() == w.ids and r["decoded"] == library.decode(w.ids, skip_special_tokens=False)
