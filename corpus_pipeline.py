"""From raw documents to packed training sequences, in stages that are each written before the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameops.llm import common, decontaminate, secret_scan, simhash, toxicity
from frameops.llm.queries import packed
from frameops.session import stage


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the model is fitted on the labels of the folder and on the documents that come in."""
    model = toxicity.fit_toxicity(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    return simhash.keep_one_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; passages below that share are cut out of the text."""
    return decontaminate.remove_contamination(docs, common.table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are masked."""
    return secret_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left and their places in training sequences."""
    return packed(docs)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_copies),
    ("decontamination", benchmark_passages),
    ("secrets", secrets),
    ("packing", pack),
]

# Model scores and token ids cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each but the last written to the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
