import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as p
from sealwright.llm import decontamination, language_id, order_minhash, source_mixing, token_output

from .test_source_mixing import brute_targets

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in p.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mixing", "token_output"]
    held = {}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out = spark.createDataFrame(out.collect(), docs.schema)
        held[name] = (docs, out)
        docs = out
    before, after = held["language_id"]
    classifier = language_id.Classifier(language_id.dictionaries(before))
    import regex

    clean = lambda t: regex.sub(r"[^\p{L}]+", " ", (t or "").lower())
    want = {r["doc_id"] for r in before.collect() if not classifier.predict(clean(r["text"]))[3]}
    assert {r["doc_id"] for r in after.collect()} == want and len(want) >= 0.98 * before.count()
    before, after = held["near_dedup"]
    classes = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(before).collect()}
    assert {r["doc_id"] for r in after.collect()} == set(classes.values()) and after.count() < before.count()
    before, after = held["decontamination"]
    hit = {r["doc_id"] for r in decontamination.contaminated(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert hit and {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - hit
    before, after = held["source_mixing"]
    words = lambda d: {r[0]: r[1] for r in d.groupBy("source").agg(F.sum(source_mixing.n_words(F.col("text")))).collect()}
    want, got = brute_targets(words(before)), words(after)
    assert all(abs(got.get(s, 0) - n) <= max(0.05 * n, 3 * source_mixing.BLOCK_WORDS) for s, n in want.items())
    assert after.filter(F.char_length("text") != F.col("n_chars")).count() == 0
    rows = sorted(((r["doc_id"], r["text"]) for r in after.collect()), key=lambda r: (r[0], r[1].encode()))
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(token_output.tokenizer_file("word_bpe_49k.json")).encode_batch([t for _, t in rows], add_special_tokens=False)
    want, start = [], 0
    for (doc_id, _), e in zip(rows, ids):
        x = [*e.ids, 2]
        want.append((doc_id, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted((tuple(r) for r in p.STAGES[-1][1](spark, after, SF).collect()), key=lambda r: r[1]) == want


def test_run_gives_the_same_again(spark):
    one, two = (sorted(map(tuple, p.run(spark, SF).collect())) for _ in range(2))
    assert one == two and len(one) > 100
