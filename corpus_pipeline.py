"""From raw documents to packed training sequences.

toxicity: rejected documents go. near_duplicates: of each group linked by 5-word shingles at 0.8
or more, the document of smallest id stays. mixing: sources reach their target shares; a document
is there as often as the mix takes it. packing: the pieces of all sequences.

Every stage takes all rows that its predecessor kept, as reread from Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import jaccard, mixing, packing, toxicity
from spindrift.llm.common import staged, table, unstaged


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.training_rows())
    return toxicity.without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", without_toxic), ("near_duplicates", near_duplicates), ("mixing", mixed), ("packing", packed)]

#: Boosted trees and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            unstaged(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
