"""The corpus pipeline: quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept,
written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import packing, pii, quality, simhash
from wayfold.llm.common import cut, drop


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.7; the others go.

    Null and empty texts get the score of a text without n-grams and stay or go by it; very
    long texts are scored whole; repeated rows and ids are judged each; without labels all
    stay; an empty table stays empty; other columns pass unread."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.learn(docs, labels), threshold=0.7)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of smallest doc_id: SimHash groups on 5-word
    shingles, then groups at a Jaccard similarity of these of 0.8 or more.

    Null, empty and blank texts are one group; texts of up to five words are equal or
    different; of rows that share an id, those of different groups all stay, and one of each
    group; rows with a null id stay; an empty table stays empty."""
    return simhash.one_of_each(docs)


def stage_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in angle brackets.

    Null and empty texts stay as they are; n_chars follows the text; repeated rows are
    redacted each; very long texts are read whole; an empty table stays empty."""
    return pii.redact(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence of at most 2048 tokens, with its ids.

    Null and empty texts are just their end id; long texts are cut; repeated rows and ids are
    packed each; an empty table gives no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", stage_quality),
    ("near-duplicates", stage_near_duplicates),
    ("personal data", stage_personal_data),
    ("packing", stage_packing),
]

#: Learnt weights, fingerprints of hashes and token ids are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of ``documents``."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "-"))
            drop(done)
            done = docs
    return docs
