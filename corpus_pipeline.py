"""A corpus pipeline of training-data operators, from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
its result is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, ngram_join, packing, quality_rules, toxicity
from sparkloom.llm.common import new_path

#: Toxicity cannot be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None
TOXIC_FROM = 0.7


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM; labels outside the held-out fold teach the lexicon."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    lexicon = toxicity.fit(docs, labels)
    # scored in the same pass that reads the documents: no join back
    return toxicity.reject(docs, lexicon, TOXIC_FROM)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the web policy's rules."""
    return quality_rules.keep_passing(docs, ("web", 2))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest id."""
    return exact_dedup.drop_copies(docs, keep="largest")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the smallest id."""
    return ngram_join.keep_one(docs, n=5, percent=75)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids with their sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, room=4096)


STAGES = [
    ("toxicity", without_toxic),
    ("quality rules", of_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, f"stage{i}")
            docs.write.option("compression", "zstd").parquet(path)
            docs = spark.read.parquet(path)
    return docs
