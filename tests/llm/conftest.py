import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, words="the of and to in stone river cloud quiet lamp winter garden paper seven copper orchard signal harbor meadow lantern"):
    pool = words.split()
    return " ".join(rng.choice(pool) + rng.choice(["", "s", "ed", "ing", "er"]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def odd_texts(rng):
    """Texts that every operator must get through: null, empty, white space, marks, wide characters, a very long one."""
    return [None, "", "   \n\t", "!!! ???", "a", "é", "日本語 テキスト", "<|endoftext|> x", "don't we'll", sentence(rng, 40), sentence(rng, 30_000), "x" * 5000, "naïve ÉCOLE Straße İstanbul ΣΟΦΟΣ"]


@pytest.fixture()
def rng():
    return random.Random(7)


@pytest.fixture()
def make(spark):
    """Rows of (doc_id, text, source) as a documents table with columns that clash with operators' own."""

    def docs(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        from pyspark.sql import functions as F

        return df.select("*", F.lit("mine").alias("size"), F.lit(1).alias("score"), F.lit(2).alias("node"), F.lit("k").alias("key"))

    return docs
