"""Prepares the table ``documents`` for training: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from routeyard.llm import near_dedup, packing, quality, toxicity
from routeyard.llm.common import stored, table

# Training data keeps no two documents this alike, in percent of shared shingles; op1_near_dedup's 85 is its contract's.
SIMILAR = 80
# Trees of two root positions: at this threshold all eight miss a pair with probability 0.2 ** 8.
TREES = 4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't call toxic.

    Columns pass unchanged, whatever their names; null and empty texts are scored as texts without features, repeated rows
    each like the others.
    """
    return toxicity.not_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and empty texts don't, repeated rows are judged alike, columns unchanged."""
    return quality.passing(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates, all columns unchanged.

    Texts without words all stay; of rows that repeat both doc_id and text one stays.
    """
    return near_dedup.representatives(docs, percent=SIMILAR, trees=TREES).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of at most 2048 ids; a null text is empty, a repeated row packed again."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_dedup", drop_near_copies), ("packing", pack)]

# Learned scores, minwise trees and token ids can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; every stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
