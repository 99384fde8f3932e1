"""The queries opN_<name> over the whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import ann, bpe, langid, linededup, mainhtml, merkle, neardup, packing, quality, rollup, secrets, shards, spelling
from leafmill.llm.common import in_own_run, table


@in_own_run
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@in_own_run
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = {v: (public_tokenizers.path(f"{v}.tiktoken"), public_tokenizers.PATTERN) for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    return rollup.maintained_counts(table(spark, sf_dir, "documents"), versions)


@in_own_run
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@in_own_run
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@in_own_run
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract_pages(table(spark, sf_dir, "pages"))


@in_own_run
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


@in_own_run
def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), shards=40)


@in_own_run
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents"))


@in_own_run
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@in_own_run
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@in_own_run
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@in_own_run
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


@in_own_run
def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_main_text": op5_main_text,
    "op6_neighbours": op6_neighbours,
    "op7_shards": op7_shards,
    "op8_line_dedup": op8_line_dedup,
    "op9_secrets": op9_secrets,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_spelling": op11_spelling,
    "op12_merkle": op12_merkle,
    "op13_language": op13_language,
}

ORACLES: dict[str, str] = {"op7_shards": shards.ORACLE, "op8_line_dedup": linededup.ORACLE, "op11_spelling": spelling.ORACLE, "op12_merkle": merkle.ORACLE}
