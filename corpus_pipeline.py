"""The corpus pipeline: from raw documents to a training mix.

``STAGES`` run in order; each reads all that its predecessor kept, written as Parquet in the
shared folder that ``spark.checkpoint.dir`` names.  All but the last return the columns of
documents.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relfeat.llm import decontam, mixing, near_join, quality, toxicity
from relfeat.llm.queries import table
from relfeat.session import ensure_checkpoint_dir, ship_package


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably of a good grade; rejected ones go."""
    ship_package(spark)
    model = quality.fit_quality(docs, quality.label_grades(table(spark, sf_dir, "labels")), quality.GRADES)
    return quality.score_quality(docs, model, tail=quality.GOOD).where(F.col("tail_probability") >= 0.5).select(*docs.columns)


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably not toxic; rejected ones go."""
    ship_package(spark)
    model = toxicity.fit_chain(docs, toxicity.toxic_labels(table(spark, sf_dir, "labels")), toxicity.CATEGORIES)
    return toxicity.score_chain(docs, model).where(F.col("p_toxic") < 0.5).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8 or more), the document
    with the smallest id, in one row."""
    ship_package(spark)
    return near_join.keep_first(docs, one_row=True)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    ship_package(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each."""
    ship_package(spark)
    return mixing.mix_sources(docs).where("taken > 0")


STAGES = [("quality", keep_quality), ("toxicity", keep_harmless), ("near_duplicates", keep_one_of_each_group),
          ("decontamination", keep_uncontaminated), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    base = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs


#: Fitted classifiers can't be expressed in SQL; tests hold every stage against brute force.
ORACLE_SQL = None
