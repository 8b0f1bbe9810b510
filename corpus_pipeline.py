"""A training corpus from raw documents: five stages, each over all rows that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. `run` writes nothing but what the stages'
own checkpoints need; a caller that wants each stage on disk writes its result as Parquet and hands the reread table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import decontaminate, near_copies, packing, simhash_dedup, substring_dedup, toxicity
from lexispark.llm.common import durable, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id. Copies are what SimHash links, and what five-word shingles show to be 0.8 alike."""
    return simhash_dedup.deduplicate(docs, further=near_copies.links)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out."""
    return substring_dedup.remove_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left, a row a piece."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("simhash_near_dedup", near_dedup_stage), ("substring_dedup", substring_dedup_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: The classifier, the components and the packing plan have no SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's rows are checkpointed, as later stages read them more than once."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs
