"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing to target weights, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridelens.llm.common import discard, documents, materialize, own_tables, table
from ridelens.llm.decontaminate import drop_contaminated
from ridelens.llm.mixing import mix_documents
from ridelens.llm.simhash import keep_one_of_each
from ridelens.llm.token_files import token_output
from ridelens.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity reaches the limit go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return keep_one_of_each(docs, shingle=3, max_bits=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' place in the token files, read back from them."""
    return token_output(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

# SQL has neither the model fit, XXH64 nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next.

    Once a stage is written, its input (if it is the stage's before it) and the tables it made on its way are removed.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with own_tables(spark):
            kept = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
