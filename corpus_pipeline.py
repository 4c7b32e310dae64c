"""A corpus, from raw documents to packed training sequences. Each stage works on what the stage before kept.

STAGES: (name, function) with function(spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents.
Of a table without rows every stage makes one without rows. Columns that documents have besides are passed on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assayer.llm import exact, neardup, packing, quality, substring
from assayer.llm.common import documents, free_since, mark, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null text is scored as an empty one; repeated rows go or stay alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept_rows(docs, quality.train(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays, null equal to empty; of rows alike in both one. Null ids stay only for a
    text that no other row has."""
    return exact.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their two-word shingles, as operator 5 has them, the one with the smallest doc_id stays; documents without
    words are linked with none. Of a group without any id one row stays."""
    return neardup.kept_rows(docs, width=2, threshold=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that also stand in an earlier document are cut from texts, null being the earliest id; no document
    goes, and texts without words stay as they are."""
    return substring.kept_texts(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts, packed into sequences; a null or empty text is one piece, its end. Repeated rows are packed each for itself."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: A trained model, token ids and packing cannot be expressed in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        point = mark()
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        free_since(point, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
