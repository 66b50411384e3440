"""A corpus pipeline: quality filter, toxicity filter, near-duplicate removal, packing.

Each stage takes the session, the documents that its predecessor kept, and the folder of the tables. All
but the last return rows of ``documents`` with all their columns; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvaframe.llm import packing, quality, similar, toxicity
from sylvaframe.llm.common import stored
from sylvaframe.llm.labelled import fold


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores at 0.7 or more stay."""
    return quality.keep_rows(docs, quality.train(docs, _labels(spark, sf_dir), fold("doc_id", 4) != 2), 0.7)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.5 stay."""
    return toxicity.keep_rows(docs, toxicity.train(docs, _labels(spark, sf_dir), fold("doc_id", 5) != 0), 0.5)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the least id: texts whose five-word shingles have a Jaccard
    similarity of 0.8 or more. Links are exact; a pair at a similarity of 0.8 is found with probability 0.95, at 0.9 with 0.99."""
    return similar.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    packed = packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_filter),
    ("toxicity", toxicity_filter),
    ("simhash near-dedup", near_duplicate_filter),
    ("best-fit packing", best_fit_packing),
]

#: Trained models, XXH64 and a tokenizer's file can't be expressed in SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents; what a stage keeps is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
