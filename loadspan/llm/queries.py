"""Queries of the text operators with their production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadspan.llm import (
    boosted, bpe_tree, edit_counts, embed_forest, html_template, jaccard, license_scan, packing, phrase_index, quality_rules,
    token_align, toxicity, url_automaton,
)
from loadspan.llm.common import configure

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    """Path of a public vocabulary; the driver and the executors have it at the same place."""
    return importlib.import_module("public_tokenizers").path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(folds: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_forest.near(table(spark, sf_dir, "embeddings"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.round_trip(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"), tokenizer(PIECES))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(5) == 0
    scores = boosted.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= boosted.THRESHOLD).cast("int").alias("predicted"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.count_edits(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(3) == 1
    scores = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_automaton.judge(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.measure(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE), tokenizer(PIECES))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.collocations(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {
    f.__name__: f for f in (
        op1_embedding_near_dedup, op2_bpe_round_trip, op3_best_fit_packing, op4_quality_rules, op5_quality_classifier,
        op6_ngram_jaccard_join, op7_token_counts, op8_html_extraction, op9_toxicity, op10_url_filters,
        op11_token_alignment, op12_phrase_collocations, op13_license_scan,
    )
}
ORACLES = {"op10_url_filters": url_automaton.oracle(), "op12_phrase_collocations": phrase_index.oracle()}
