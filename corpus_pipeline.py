"""Documents to training sequences, stage by stage.

Every stage takes the documents the one before kept and returns documents (the last: sequences of
tokens). Toxic documents go, one document of each group of near-duplicates stays, documents that
hold a benchmark item go, secrets are masked in the texts that hold them, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.llm import alike, decontaminate, packing, secret_scan
from txnrisk.llm import toxicity as tox
from txnrisk.llm.common import given, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half.

    The model learns from the labelled rows among ``docs``. The decision is taken on the row itself,
    so null ids and repeated rows are judged each for itself.
    """
    model = tox.train(docs, given(spark, sf_dir, "labels"))
    return tox.without_toxic(docs.select(COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 0.8 or more of their five-word shingles the document with the
    smallest id, of equal rows one."""
    return alike.one_of_each(docs.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.without_leaks(docs.select(COLUMNS), given(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts and n_chars as it is then."""
    clean = secret_scan.redact(secret_scan.secret_scan(docs.select(COLUMNS)))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("best_fit_packing", best_fit_packing),
]

#: A trained model and a fixpoint over links: no SQL for these rows; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again as the next one's input."""
    docs = given(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
