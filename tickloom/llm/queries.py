"""Registered queries of this subpackage, and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import oracles
from tickloom.llm.chat import TURN_TOOLS, calls_from_turns, link_tool_calls
from tickloom.llm.collocations import collocations
from tickloom.llm.decontaminate import matched_items
from tickloom.llm.divergence import source_divergence
from tickloom.llm.html import extract_text, train
from tickloom.llm.language import held_out, identify_language, language_prototypes
from tickloom.llm.licenses import scan_licenses
from tickloom.llm.mixing import mix
from tickloom.llm.near_dedup import near_duplicates
from tickloom.llm.quality import repetition
from tickloom.llm.suffix_dedup import repeated_bytes
from tickloom.llm.tables import new_path
from tickloom.llm.token_files import read_token_files, token_ids, write_token_files
from tickloom.llm.warc import page_records, read_records, write_archives

#: The id that op12 appends to every document.
END_OF_TEXT = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return extract_text(pages, train(pages))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matched_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_sort("items")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(_table(spark, sf_dir, "pages"), path)
    return page_records(read_records(spark, path))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    mixed = mix(docs.withColumn("domain", corpus_pipeline.domain_of("source")), corpus_pipeline.LEVELS, corpus_pipeline.WEIGHTS)
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(_table(spark, sf_dir, "documents"))


def op8_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(calls_from_turns(_table(spark, sf_dir, "conversations")), TURN_TOOLS)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learned = language_prototypes(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return identify_language(docs, learned)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token_files")
    write_token_files(token_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_OF_TEXT, by_word=True), path)
    found = read_token_files(spark, path)
    n_tokens = F.octet_length("ids").cast("long") / 4
    return found.select(F.col("id").alias("doc_id"), "start", n_tokens.cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_warc": op4_warc,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_chat_tool_calls": op8_chat_tool_calls,
    "op9_language_id": op9_language_id,
    "op10_license_scan": op10_license_scan,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_files": op12_token_files,
    "op13_phrase_collocations": op13_phrase_collocations,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": oracles.NEAR_DEDUP,
    "op3_benchmark_decontamination": oracles.DECONTAMINATION,
    "op4_warc": oracles.WARC,
    "op6_source_mixing": oracles.mixing(corpus_pipeline.LEVELS, corpus_pipeline.WEIGHTS),
    "op7_quality_rules": oracles.QUALITY,
    "op8_chat_tool_calls": oracles.CHAT,
    "op11_source_divergence": oracles.DIVERGENCE,
    "op13_phrase_collocations": oracles.COLLOCATIONS,
}
