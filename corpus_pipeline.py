"""The corpus pipeline: language, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
stages but the last keep the columns of documents and work on every row that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm.op2_hilbert_pack import pack_along_curve
from tidegrid.llm.op6_simhash import keep_first_of_groups
from tidegrid.llm.op7_toxicity import drop_toxic, fit_toxicity_model
from tidegrid.llm.op10_langid import fit_language_model, fold_of, keep_identified
from tidegrid.session import ship_package, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts whose n-grams are those of none of the learned languages."""
    ship_package(spark)
    return keep_identified(docs, fit_language_model(docs, fold_of("doc_id", 4) != 2))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that score 0.5 or more."""
    ship_package(spark)
    return drop_toxic(docs, fit_toxicity_model(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 5) != 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    ship_package(spark)
    return keep_first_of_groups(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens along the Hilbert curve."""
    ship_package(spark)
    return pack_along_curve(docs)


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", packing)]

#: SQL can express neither the learned stages nor packing: the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
