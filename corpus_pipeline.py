"""The corpus pipeline over documents: quality classifier, SimHash near-dedup, repeated-window removal, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import packing, pii, quality, repeats, simhash
from graphloom.llm.common import load, materialize

#: Near-duplicates: shingles of five words, Jaccard similarity of 0.8 and more.
SHINGLE, SIMILARITY = 5, 0.8


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score of at least quality.THRESHOLD)."""
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))  # whatever the other columns are called
    return quality.score(rows, model, "row").where(F.col("score") >= quality.THRESHOLD).select("row.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id."""
    return simhash.one_of_each(docs, SHINGLE, SIMILARITY)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of windows that also start in a document with a smaller doc_id."""
    return repeats.without_repeats(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in brackets."""
    return pii.redact(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed windows over all documents' token streams."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", one_of_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("pii", mask_pii),
    ("packing", pack),
]

#: SQL can't express the stages; tests compare each with a brute-force version on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
