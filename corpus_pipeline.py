"""A training corpus from raw documents: low quality out, copies out, near
copies out, languages mixed to target weights, the rest packed into sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns rows with the columns of ``documents``; the last returns the
pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafgrid.llm import exact_dedup, mixing, near_dedup, packing, quality
from leafgrid.llm.common import Tables
from leafgrid.llm.queries import domain_labels, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def mixed_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, domain_labels(docs, table(spark, sf_dir, "labels")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed_languages),
    ("packing", packed),
]

#: The stages learn models and pack greedily, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``, each written as Parquet to
    the shared folder before the next one reads it.  A stage's tables are
    deleted when the next stage is written; the result's when Spark ends."""
    docs = table(spark, sf_dir, "documents")
    with Tables(spark) as written:
        for _, stage in STAGES[:-1]:
            with Tables(spark) as own:
                docs = own.result(stage(spark, docs, sf_dir))
            written.drop(latest=1)
        return written.result(STAGES[-1][1](spark, docs, sf_dir))
