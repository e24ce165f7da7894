"""A training corpus from documents: each stage calls one operator of ``sparkloom.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again for the next one.  All but the last return the
columns of ``documents``.  Rows without doc_id and without text pass through all
filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import minhash, packing, passages, secrets, toxicity
from sparkloom.llm.common import saved, sized, table


def clean_of_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (op 7), fitted on the labels, scores below one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return model.clean(docs, below=0.5)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (op 10, five words, 0.8) the document with the smallest doc_id."""
    classes = minhash.near_duplicates(docs, percent=80, words=5)
    gone = saved(classes.where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(sized(gone), "doc_id", "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages (op 4) that a document with a smaller doc_id keeps."""
    return passages.deduplicated(docs, passages.repeated_passages(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets (op 5) masked."""
    return secrets.redacted(docs, secrets.secrets(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batches (op 2) that the documents form, one row for each document."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", clean_of_toxic),
    ("minhash_near_dedup", one_of_near_duplicates),
    ("substring_dedup", without_repeats),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: A fitted classifier, a Viterbi search, chaining and a forest aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
