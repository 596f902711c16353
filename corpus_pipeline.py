"""From raw documents to training sequences, in five stages that each call one operator of the llm subpackage.

Each stage works on what its predecessor kept. Its output is written as Parquet to the shared folder and read again, so a lost
executor costs tasks of one stage and no more. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.llm import decontam, packing, pii, quality, similar
from epochal.llm.queries import TOKENIZER
from epochal.llm.shared import durable, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores 0.3 or more stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates one document stays, that with the least doc_id.

    Linked are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and those that the operator's
    query links: fingerprints over three words that differ in at most three bits of 64.
    """
    return similar.keep_one_similar(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or with other values, go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; ``n_chars`` follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, at most 2048, with their ids."""
    return packing.pack_binary(docs, TOKENIZER, max_length=2048, end_id=1, with_ids=True)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: SQL expresses neither the classifier nor the tokenizer; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
