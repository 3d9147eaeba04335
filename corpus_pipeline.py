"""Documents to training sequences: quality, near duplicates, decontamination, surrogates, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
Null and empty texts pass through every stage with the result that its operator defines; an empty table gives an
empty table; extra columns of documents are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm import decontaminate, near_dedup, pack, quality, surrogates
from lectern.llm.common import read, release, scratch_path
from lectern.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    rated = quality.score(docs.select(F.struct("*").alias("_row"), "text"), model, keep=("_row",))
    return rated.where(F.col("score") >= quality.THRESHOLD).select("_row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: rows that hold several or little else go, single passages are cut out."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def without_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose personal data are surrogates, by the session's key or one of this run's own."""
    return surrogates.pseudonymise(docs, surrogates.session_key(spark)).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in training sequences."""
    return pack.pack(docs, tokenizer_path())


STAGES = [
    ("quality", keep_good),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("pii", without_persons),
    ("packing", sequences),
]

#: SQL has no conditional random field, banded alignment or byte-pair merges; tests/llm compares each stage's operator with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of documents. A stage's scratch tables go once its result is written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, keep=(path,))
    return STAGES[-1][1](spark, docs, sf_dir)
