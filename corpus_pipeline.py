"""A corpus from raw documents to sampled piece ids.

Each stage is a function of (spark, docs, sf_dir) whose result is written as
Parquet and read again as the next one's ``docs``.  Stages take rows with null
or repeated ids, empty tables and further columns of any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, exact_dedup, near_dedup, quality, sentencepiece_sampling
from tidemill.llm.shared import hide, shown, table, write_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on ``labels``, does not reject.

    Null and empty texts have the score of the intercept; repeats fare alike.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    plain, names, (text,) = hide(docs, (), "text")
    return quality.score_quality(plain, model, text).filter(F.col("score") >= quality.THRESHOLD).select(*shown(names))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those that are equal but for white space; null and empty texts are one group."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingle sets of similarity 0.8 or more; texts without words stay."""
    return near_dedup.near_dedup(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no window of ten words of ``benchmark``; texts without words stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document: doc_id, sample, ids, logp, inclusion; a null or empty text has the empty one."""
    return sentencepiece_sampling.encode(docs, sentencepiece_sampling.load_pieces()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_benchmark),
    ("sentencepiece", sampled_pieces),
]

#: SQL has no support vector fit, MinHash chain or lattice sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
