"""The corpus pipeline: each stage works on all documents that its predecessor kept.

Defined results, for each stage: null texts count as empty ones; null ids, sources and languages are values like others; other
columns than those of documents go; an empty table gives an empty one. Quality: null and empty texts have a score like all
others; without labels of both classes, every document has the share of label 1 as its score. Exact dedup: rows that repeat id
and text are one. Near dedup: texts without words are near to nothing, and all of them stay. Mixing: rows that repeat id, source
and size share out their copies; documents without words are not taken. Tokens: texts without words have no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, mixing, ngram_join, pieces, quality
from lodestone.llm.shared import emptied, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of documents that are not held out."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 or more on five-word shingles, the row with the smallest id."""
    return ngram_join.one_of_each(docs, words=5, percent=80).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of sources takes them."""
    return mixing.mixed(docs).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row's text."""
    ids = pieces.encode(docs, carry=["doc_id", "lang", "source"])
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: Training and encoding can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
            if k:
                emptied(before)
    return docs
