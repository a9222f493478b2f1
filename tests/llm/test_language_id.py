import random
import zlib

from pyspark.sql import functions as F

from sealwright.llm import language_id as m

from .conftest import DOCS, odd_texts, sentence

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = m.identify(docs.select("doc_id", "text", "lang")).withColumn("held_out", m.held_out(F.col("doc_id"))).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    right = [r for r in held if r["lang_pred"] == r["lang"]]
    assert len(right) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) <= 0.01 * len(rows)
    assert {r["lang_pred"] for r in rows} <= {"en", "de", "fr", "es", "und"}


def test_languages_of_unequal_samples(spark):
    """A language with a small sample, and one with next to none, cost neither it nor the others their short texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = m.dictionaries(docs)
    held = docs.filter(m.held_out(F.col("doc_id")) & (F.length("text") > 200)).select("lang", m.letters(F.col("text")).alias("text")).collect()
    texts = [(r["lang"], x) for r in held for x in (r["text"].strip()[:60], r["text"].strip()[:300], r["text"])]
    small = learned | {"de": learned["de"][:3072]}

    def right_and_rejected(learned):
        c = m.Classifier(learned)
        out = [(lang, c.predict(x)) for lang, x in texts]
        return sum(p[0] == lang for lang, p in out) / len(out), sum(p[3] for _, p in out) / len(out)

    right, rejected = right_and_rejected(learned)
    print(right, rejected)
    for other in (small, learned | {"xx": b"a rare language of which there are some words only"}, small | {"xx": b"q"}, small | {"xx": b""}):
        got = right_and_rejected(other)
        print(got)
        assert got[0] >= 0.98 and got[1] <= rejected + 0.002


def test_carriers_are_as_many_for_each_sample():
    for n in (0, 1, 2, 51, 2047, 3072, 40_000):
        carriers, rest = m.carriers_of(bytes(range(256)) * 200 if n > 51_000 else bytes(i % 251 for i in range(n)))
        assert len(carriers) == m.CARRIERS and len(rest) == n - min(m.CARRIERS * m.CARRIER_BYTES, n // 2)
        assert {len(c) for c in carriers} == {min(m.CARRIER_BYTES, n // 2)}


def test_only_the_text_counts(spark, rng):
    learned = {"aa": sentence(random.Random(1), 900, 'water house green tree').encode(), "bb": sentence(random.Random(1), 900, 'pxlo zruk qwab vyxo').encode()}
    texts = odd_texts(rng) + ["green tree water house water", "zruk vyxo pxlo zruk qwab"]
    a = spark.createDataFrame([(i, x, "zz", "s", 0) for i, x in enumerate(texts)], DOCS)
    b = spark.createDataFrame([(None, x, None, None, None) for x in texts], DOCS)
    one, two = ([tuple(r)[-4:] for r in m.identify(d, learned).orderBy("text").collect()] for d in (a, b))
    assert one == two
    got = dict(zip([r["text"] for r in m.identify(a, learned).collect()], m.identify(a, learned).collect()))
    assert got["green tree water house water"]["lang_pred"] == "aa" and got["zruk vyxo pxlo zruk qwab"]["lang_pred"] == "bb"
    for x in (None, "", "   \n\t", "!!! ???"):
        assert (got[x]["lang_pred"], got[x]["score"], got[x]["rejected"]) == (m.UNKNOWN, 0.0, True)
    assert got["é"]["lang_pred"] in learned


def test_nothing_to_learn_from(spark, make):
    assert m.identify(make([])).collect() == []
    null_lang = spark.createDataFrame([(1, "some text", None, "s", 9), (2, None, "en", "s", 0)], DOCS)
    assert {r["lang_pred"] for r in m.identify(null_lang).collect()} == {m.UNKNOWN}


def test_columns_with_the_results_names_are_replaced(spark, make):
    out = m.identify(make([(1, "text", "s")]), {"aa": b"text text"})
    assert out.columns.count("score") == 1 and out.first()["score"] == 1.0


def test_a_batch_is_worked_off_in_parts(spark, monkeypatch, rng):
    """An Arrow batch is a task's whole share: no more than a part of it is held as texts and rows."""
    import pyarrow as pa

    from sealwright.llm import shared

    learned = m.dictionaries(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    texts = [sentence(rng, 20) for _ in range(100)] + [None, "", sentence(rng, 2000), " "]
    monkeypatch.setattr(shared, "PIECE_BYTES", 5000)
    parts = list(m.predictions(iter([pa.array(texts), pa.array([], pa.string())]), learned))
    assert len(parts) > 3 and max(map(len, parts)) < 100
    classifier = m.Classifier(learned)
    assert [tuple(r.values()) for part in parts for r in part.to_pylist()] == list(map(classifier.predict, texts))
