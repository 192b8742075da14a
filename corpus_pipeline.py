"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import mixing, pieces, quality, simhash, substring
from tablewright.llm.common import stored, table

#: fingerprints and sampled segmentations have no form in SQL; tests compare with brute force
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that their host repeats."""
    return quality.cleaned(docs)


def simhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints (three-word shingles, three bits), the document with the smallest id stays."""
    return simhash.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every passage of 35 words or more that stands elsewhere goes; the documents stay."""
    return substring.deduped(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate says."""
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds a sampled segmentation, its length and whether it spells the text again."""
    encoded = pieces.encode(docs, verify=True)
    ids, same = encoded.columns[-2:]
    return encoded.select(
        *docs.columns, F.col(ids).alias("pieces"), F.coalesce(F.size(ids), F.lit(0)).cast("long").alias("n_pieces"),
        F.col(same).alias("lossless"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_neardup", simhash_neardup),
    ("substring_dedup", substring_dedup),
    ("mix_to_targets", mix_to_targets),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
