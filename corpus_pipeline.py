"""Quality classifier, near-dedup, secret scan, mixing and packing over ``documents``, one after another.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with
the columns of ``documents``. What a stage decides shows in its rows: rejected documents and all but one of near copies
are gone, secrets are masked in the texts, rows lie in the order of the mixing schedule, and the last stage gives the
packed pieces, whose sequences keep to that order as the files have it.

Defined cases: those of the operators that the stages call. Nulls in any column, empty and very long texts and repeated
rows pass through; an empty table gives no rows; further columns of ``documents`` stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldlake.llm import bagminhash, mixing, packing, quality, secret_scan
from foldlake.llm.common import scratch, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest doc_id."""
    return bagminhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret_scan.mask_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule for the sources' target weights."""
    return mixing.in_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, in the order in which ``docs`` were written."""
    return packing.pack_in_order(docs)


STAGES = [("classify", classify), ("near_dedup", near_dedup), ("secrets", secrets), ("mixed", mixed), ("packed", packed)]

#: Training and hashing have no form in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs, place = table(spark, sf_dir, "documents"), scratch(spark, "corpus")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{place}/{k}")
            docs = spark.read.parquet(f"{place}/{k}")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
