import io
import zlib

import numpy as np
import pytest

from sealwright.llm import token_output as t

from .conftest import odd_texts, sentence

PATH = t.tokenizer_file("word_bpe_49k.json")


def whole(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_words_give_the_ids_of_the_whole_text(rng):
    texts = odd_texts(rng)[1:] + [sentence(rng, 50) for _ in range(20)] + ["A--B (c) 'quoted' it's 12,5% x²   y  z áé <|startoftext|>The"]
    enc = t.WordIds(PATH, "<u2")
    assert [np.frombuffer(enc.encode(x), "<u2").tolist() for x in texts] == whole(texts)


def test_separators_are_tokens():
    texts = [x.replace("#", c) for c in "\x1c\x1d\x1e\x1f" for x in ("ab#cd", "ab # cd", "#ab cd#", "#", " ## ", "a#\nb\t#c", "Ab,#.Cd <|x|>#", "é#日本", "\u2003#\u00a0#x\x85y\u3000z")]
    texts += ["\x1c\x1d\x1e\x1f", "a\x1c\x1d b\x1e \x1fc"]
    enc = t.WordIds(PATH, "<u2")
    assert [np.frombuffer(enc.encode(x), "<u2").tolist() for x in texts] == whole(texts)


def test_words_kept_are_bounded(rng):
    """Workers keep them through later stages: a word's letters and marks aren't kept beside the words, once more."""
    texts = [" ".join("".join(rng.choice("abcdeAB") for _ in range(rng.randrange(1, 7))) + rng.choice(["", "", ".", ",", "!?", "'", "'s"]) for _ in range(200)) for _ in range(30)]
    enc = t.WordIds(PATH, "<u2", most=100)
    for text, want in zip(texts, whole(texts), strict=True):
        assert np.frombuffer(enc.encode(text), "<u2").tolist() == want
        assert sum(len(x) for x in [enc, *vars(enc).values()] if isinstance(x, dict)) <= 200
    enc = t.WordIds(PATH, "<u2")
    enc.encode("Stone, stone. STONE stone")
    assert set(enc) == {"Stone,", "stone", ",", "stone.", ".", "STONE"}
    assert t.WordIds(PATH, "<u4").encode(texts[0]) == np.array(whole(texts[:1])[0], "<u4").tobytes()


def test_latin1_words_skip_the_normalizer(rng):
    """Of letters that NFC keeps and marks: no call of the whole library for them, and letters and marks are held once."""
    letters = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
    plain = [*letters, letters, letters.lower(), "Été, été. ÉTÉ été", "Straße!? naïve:; ñandú&&& a" + letters + "z"]
    plain += [" ".join("".join(rng.choice(letters + "aeinrstAEST") for _ in range(rng.randrange(1, 12))) + rng.choice(["", ".", ",", "###", "<", "|>"]) for _ in range(300))]
    enc, asked = t.WordIds(PATH, "<u2"), []

    class Asked:
        def encode(self, word, **how):
            asked.append(word)
            return library.encode(word, **how)

    library, enc.tokenizer = enc.tokenizer, Asked()
    assert [np.frombuffer(enc.encode(x), "<u2").tolist() for x in plain] == whole(plain)
    assert asked and not [w for w in asked if any(c.isalpha() for c in w)]  # marks alone
    near = ["e\u0301té", "é\u0301", "é \u0301", "µé", "éª", "éº.", "é×è", "é÷", "Ÿé", "éİ", "œuvre", "é's", "l'été", "é1", "é-è", "¿Qué?", "é<|endoftext|>", "é<|", "é\xad", "é\x1c", "ÿ\u0308", "Å"]
    enc = t.WordIds(PATH, "<u2")
    assert [np.frombuffer(enc.encode(x), "<u2").tolist() for x in near] == whole(near)
    enc = t.WordIds(PATH, "<u2")
    enc.encode("Été, été. ÉTÉ été")
    assert set(enc) == {"Été,", "été", ",", "été.", ".", "ÉTÉ"}


def test_round_trip_and_single_frames(rng):
    class Out(io.BytesIO):
        def close(self):
            pass

    class Source(io.BytesIO):
        reads = 0

        def size(self):
            return len(self.getvalue())

        def read(self, n=-1):
            Source.reads += n
            return super().read(n)

    docs = [(i if i else None, np.array([rng.randrange(49_000) for _ in range(rng.randrange(4000))], "<u2").tobytes()) for i in range(60)]
    out = Out()
    writer = t.TokenFileWriter(out, 2, frame_bytes=20_000)
    for d in docs:
        writer.add(*d)
    writer.close()
    reader = t.TokenFileReader(Source(out.getvalue()))
    assert [(d, ids) for d, ids, _ in reader.documents()] == docs
    Source.reads = 0
    assert [(d, ids) for d, ids, _ in reader.documents({41})] == [docs[41]]
    assert Source.reads < len(out.getvalue()) / 4  # only that document's frame
    broken = bytearray(out.getvalue())
    broken[100] ^= 1
    with pytest.raises(Exception):
        list(t.TokenFileReader(Source(bytes(broken))).documents())


def test_query_against_brute_force(spark, make, rng):
    texts = odd_texts(rng) + [sentence(rng, 30)] * 3
    rows = [(100 - i, x) for i, x in enumerate(texts)] + [(None, "no id"), (5, "twice"), (5, "twice"), (5, "again")]
    got = sorted((tuple(r) for r in t.encode_and_index(spark, make(rows)).collect()), key=lambda r: r[1])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for (doc_id, _), ids in zip(order, whole([x for _, x in order])):
        ids = [*ids, t.END_ID]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert t.encode_and_index(spark, make([])).collect() == []
