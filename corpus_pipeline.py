"""A training corpus from documents: quality, boilerplate, near duplicates, benchmark passages, mixture.

Every stage takes all that its predecessor kept, read from a Parquet table in the session's shared folder, and returns the
columns of ``documents``; the last adds what the mixture takes of each document and drops those it takes nothing of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeflow.llm import decontaminate, jaccard_join, line_dedup, mixing, quality_fm
from tomeflow.llm.queries import QUALITY_THRESHOLD, held_out, table
from tomeflow.llm.storage import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return quality_fm.keep_good(docs, quality_fm.train(docs, labels), QUALITY_THRESHOLD)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents freed of the lines that more than a tenth of their source's documents hold."""
    out = line_dedup.dedup_lines(docs, "source")
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard_join.one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture, with the words it takes of each."""
    return mixing.mix(docs, mixing.n_words(F.col("text")), mixing.quality_weight(F.col("text")), wide=True).where("taken > 0")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", jaccard_join_stage),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing_stage),
]

# A trained model decides the first stage, which SQL cannot express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
