"""Documents to training records, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes each result to the shared scratch folder and reads it back for the
next one.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from diffproto.llm import binary_records, decontam, langid, mixing, ngram_join
from diffproto.llm.common import read, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts, texts without a letter, and
    those the classifier scores below ``langid.MIN_SCORE`` for every language.
    ``lang`` becomes the language found; it goes into the records."""
    return langid.accepted(docs, relabel=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item, those without an id too."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"), null_ids=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's rate asks for."""
    return mixing.mix(docs)


def binary_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids, and the language of each document, as binary
    records and reads the files back."""
    data, _ = binary_records.write_records(docs, binary_records.default_tokenizer(), tag="lang")
    return binary_records.read_records(spark, data.removesuffix("/data")).withColumnRenamed("tag", "lang")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
    ("binary_records", binary_output),
]

#: Language ID and the tokenizer are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
