"""A training corpus from raw documents: quality, exact copies, near copies, the mix of sources, packing.

Extra columns of documents pass through all stages but the last; an empty table gives an empty one.
Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and is written as Parquet and reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrada.llm import exact_dedup, mixing, ngram_join, packing, quality
from contrada.llm.common import discard, table, written
from contrada.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels, rejects go; null, empty and very long texts are scored whole like others, and so are repeated rows and those without a doc_id."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; null and empty texts are equal, of repeated rows one stays."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays, the one of the smallest doc_id; texts without words and rows without a doc_id all stay."""
    return ngram_join.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: the words that it takes of documents, as often as it takes them, in runs without a gap; documents without words go, a null source is a source, and n_chars is the run's."""
    return mixing.mixed_rows(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids: every row is packed, a null or empty text as its end id alone."""
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources", mixed),
    ("packing", packed),
]

#: No SQL: classifier, mix and token ids are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table is deleted when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
            if before is not None:
                discard(before)
            before = docs
    return docs
