"""The corpus pipeline: quality rules, line dedup, near dedup, secret scans, packing.

run(spark, sf_dir) applies STAGES in order to the documents table. Each stage is a function of (spark, docs, sf_dir); its
result is written as Parquet to the folder that the cluster shares and read again as the next one's docs, so a lost executor
costs at most the tasks it ran. All stages but the last return the columns of documents, whichever those are.

A document without a text is rejected by the quality rules. Line dedup may leave a text empty; the document stays. Secrets
are masked in the text, and the document stays. n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import linededup, neardup, packing, quality, secrets
from leafmill.llm.common import in_own_run, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that other documents hold as well go, except in the first."""
    return linededup.drop_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the smallest id."""
    return neardup.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that stayed, in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near", near_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: No SQL: log ratios of hashed n-grams, BagMinHash and a tokenizer aren't expressible; tests hold run() against a brute-force version.
ORACLE_SQL = None


@in_own_run
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
