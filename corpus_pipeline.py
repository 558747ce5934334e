"""From raw documents to packed sequences: rules, classifier, one document of each near-duplicate group, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadspan.llm import boosted, jaccard, packing, quality_rules
from loadspan.llm.common import configure, stage
from loadspan.llm.queries import PIECES, WORD_BPE, fold, tokenizer

#: Words of a shingle and least similarity of the stage; the query of the join itself has its own.
NEAR_WORDS = 5
NEAR_PERCENT = 80
#: Words that a worker of the packing stage keeps the ids of: fewer than in the query, as workers still hold what earlier stages kept.
PACKED_WORDS = 80_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return quality_rules.keep(docs, tokenizer(PIECES))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = configure(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return boosted.keep(docs, labels, fold(5) != 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return jaccard.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return packing.pack(docs, tokenizer(WORD_BPE), words=PACKED_WORDS)


STAGES = [
    ("quality rules", quality), ("quality classifier", classifier), ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", best_fit),
]

#: SQL has no tokenizers and no trees; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name.replace(" ", "-"))
    return docs
