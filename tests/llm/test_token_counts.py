import random

import pytest
from pyspark.sql import functions as F

from sealwright.llm import token_counts as t
from sealwright.llm.token_output import tokenizer_file

from .conftest import odd_texts, sentence

PATH = tokenizer_file("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pre():
    return t.PreTokens(PATH)


def test_any_edits_give_the_count_of_the_edited_text(pre):
    rng = random.Random(5)
    pool = ["a", "b", " ", "  ", "\n", "'s", "'", "1", "2.5", "é", "don't", "..", "word", "\t ", "日本"]
    for _ in range(1500):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(40)))
        doc = t.EditedText.of(text, pre)
        assert doc.tree.tokens == len(pre.encoding.encode_ordinary(text))
        for _ in range(rng.randrange(1, 5)):
            at, n = rng.randrange(len(doc.text) + 1), rng.randrange(6)
            new = "".join(rng.choice(pool) for _ in range(rng.randrange(4)))
            want = doc.text[:at] + new + doc.text[at + n :]
            doc.replace(at, n, new)
            assert doc.text == want
            assert doc.tree.tokens == len(pre.encoding.encode_ordinary(want)), (text, want)
            assert doc.tree.chars[1] == len(want)
        again = t.EditedText.of_leaves(doc.text, *doc.leaves(), pre)
        assert (again.tree.tokens, again.text) == (doc.tree.tokens, doc.text)


def test_an_edit_reencodes_little(pre, rng):
    doc = t.EditedText.of(sentence(rng, 20_000), pre)
    doc.replace(60_000, 5, "something else")
    assert doc.reencoded < 100


def test_many_edits_cost_less_than_counting_again(pre, rng):
    """Every third word edited: each edit re-encodes its neighbourhood, however many edits there are."""
    text = sentence(rng, 60_000)
    doc = t.EditedText.of(text, pre)
    places = [i for i, c in enumerate(text) if c == " "][::3]
    for at in reversed(places):
        doc.replace(at, 1, " <x> ")
    assert doc.reencoded < 60 * len(places)
    assert doc.tree.tokens == len(pre.encoding.encode_ordinary(doc.text))


def test_long_unbroken_text_is_read_once(spark):
    """A run of a million letters, digits or marks has no address; the pattern must not read it from each of its places."""
    import time

    df = spark.createDataFrame([(c * 1_000_000,) for c in ("x", "a.", "1", "f", "@", "x@", "-")], "text string")
    start = time.time()
    assert [r[0] for r in df.select(F.size(t.redactions(F.col("text")))).collect()] == [0] * 7
    assert time.time() - start < 20


def test_redactions_and_counts(spark, make, rng):
    texts = odd_texts(rng) + ["write to jo.doe@mail.example.org or 10.0.0.12, card 4785380592391139!", "24be64439e3e49cf46b2d7c90f3602a3 x 1.2.3.4 1.2.3.4", "no 12345 match 1.2.3", "a@b.c-d@e.f+g@h.i"]
    docs = make(list(enumerate(texts)) + [(3, "again 10.1.1.1")] * 2)
    out = t.count_tokens(docs, t.redactions(F.col("text")), PATH)
    assert out.columns == docs.columns + [x.split()[0] for x in t.RESULT.split(", ")]
    import regex

    pre, pattern = t.PreTokens(PATH), regex.compile(t.REDACTED, regex.ASCII)
    rows = out.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = r["text"] or ""
        edited, n = pattern.subn(t.PLACEHOLDER, text)
        assert (r["tokens_before"], r["n_edits"]) == (len(pre.encoding.encode_ordinary(text)), n)
        assert r["tokens_after"] == len(pre.encoding.encode_ordinary(edited))
    assert sum(r["n_edits"] for r in rows) == 11
    short = t.count_tokens(docs, t.redactions(F.col("text")), PATH, keep_text=False)
    assert short.columns == [c for c in out.columns if c != "text"]
    assert sorted(map(repr, short.collect())) == sorted(map(repr, out.drop("text").collect()))
    assert t.count_tokens(make([]), t.redactions(F.col("text")), PATH).collect() == []


def test_edits_beyond_the_text_and_null_edits(spark, pre):
    df = spark.createDataFrame([(1, "one two", [(4, 99, "three")]), (2, "one", None), (3, None, [(0, 0, "new")]), (4, "x y", [(1, 1, None), (99, 1, "!")])], f"doc_id long, text string, edits {t.EDITS}")
    got = {r["doc_id"]: r["tokens_after"] for r in t.count_tokens(df, F.col("edits"), PATH).collect()}
    assert got == {i: len(pre.encoding.encode_ordinary(x)) for i, x in ((1, "one three"), (2, "one"), (3, "new"), (4, "xy!"))}


def test_edits_cost_as_many_steps_as_there_are_matches(spark):
    """A text with 32,000 addresses; building a list by appending copies of it took a minute."""
    import time

    df = spark.createDataFrame([("10.0.0.1 " * n,) for n in (1, 32_000)], "text string").cache()
    df.count()
    df.select(F.size(t.redactions(F.col("text")))).filter("false").collect()
    start = time.time()
    got = [r[0] for r in df.select(t.redactions(F.col("text"))).collect()]
    assert time.time() - start < 10
    assert [(e["start"], e["length"], e["replacement"]) for e in got[1]] == [(9 * i, 8, t.PLACEHOLDER) for i in range(32_000)]
    assert len(got[0]) == 1


def test_leaves_stay_pre_tokens(pre, rng):
    """A long insertion is many leaves once the tree is kept, so that the next edit in it re-encodes little."""
    doc = t.EditedText.of("begin here and end", pre)
    doc.replace(6, 4, sentence(rng, 20_000))
    again = t.EditedText.of_leaves(doc.text, *doc.leaves(), pre)
    assert again.words == pre.split(doc.text) and again.tree.tokens == doc.tree.tokens
    again.replace(50_000, 3, "xyz")
    assert again.reencoded < 100
    assert again.tree.tokens == len(pre.encoding.encode_ordinary(again.text))


def test_overlapping_edits_are_refused(spark):
    schema = f"doc_id long, text string, edits {t.EDITS}"
    for edits in ([(0, 3, "a"), (2, 1, "b")], [(4, 2, "a"), (4, 2, "b")]):
        with pytest.raises(Exception, match="edits overlap"):
            t.count_tokens(spark.createDataFrame([(1, "one two three", edits)], schema), F.col("edits"), PATH).collect()
    ok = spark.createDataFrame([(1, "one two three", [(3, 0, "!"), (3, 1, "_"), (0, 3, "x")])], schema)
    assert t.count_tokens(ok, F.col("edits"), PATH).count() == 1
