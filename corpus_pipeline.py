"""Documents to packed training sequences: quality rules, quality classifier, line dedup, near-dedup, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; its result is written
as Parquet and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import line_dedup, quality_classifier, simhash
from tessella.llm.common import written
from tessella.llm.queries import packed, quality_model
from tessella.llm.quality_rules import judge


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. A null or empty text fails the length rule and goes; rows are
    judged one by one, so ties and repeated rows stay or go alike; an empty table stays empty."""
    return judge(docs).where("kept").select(*docs.columns)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good. It learns from the labelled ones of all
    documents, as those that the rules left hardly show bad ones. A null or empty text has the share of good
    labels as its score; rows equal in text have equal scores; an empty table stays empty."""
    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_model(every.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs, model).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; one that had lines and has none left goes. A null
    or empty text has no lines and stays; rows equal in id and text are one document, treated alike; a null id
    comes last in the order; an empty table stays empty."""
    left = line_dedup.dedup(docs).where("n_lines = 0 OR n_lines > n_exact + n_near")
    changed = F.col("n_exact") + F.col("n_near") > 0
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by SimHash of three-word shingles and three bits at most:
    the one with the smallest id (null last), of rows with one id the one with the smallest hash of all
    columns. Texts without words, null ones too, are one group; equal rows are one; an empty table stays empty."""
    return simhash.first_of_each(docs, budget=3).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, each with its sequence and offset. A null or empty text is a document of its
    end id; repeated rows are packed each; an empty table gives no pieces."""
    return packed(docs)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("packing", packing)]
ORACLE_SQL = None  # a fitted classifier, merging tokens and packing are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
