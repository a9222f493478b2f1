"""A training corpus from raw documents: language ID, near-dedup, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each stage's documents
as Parquet and reads them again for the next. The last stage writes token files and returns their documents' places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sealwright.llm import decontamination, language_id, order_minhash, shared, source_mixing, token_output


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; those without letters or with a narrow margin go."""
    return docs.select(*docs.columns, language_id.predicted(docs["text"], language_id.dictionaries(docs)).alias("__p")).filter("not __p.rejected").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest id."""
    return order_minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes; a document taken more than once has a row for each time."""
    return source_mixing.copies(source_mixing.mix(docs), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the token files: doc_id, start, n_tokens, ids_crc32."""
    return token_output.encode_and_index(spark, docs)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("token_output", tokens),
]

#: SQL can't express compression, sketches and tokenizers; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
