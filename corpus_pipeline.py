"""A training corpus from raw documents, in five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, so a stage works on whatever its predecessor kept. There is no SQL for the whole: the
classifier is learnt and components are iterated; the tests hold the stages against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, linededup, mixing, quality, simhash
from lectern.llm.shared import crc_mod, cut, shared_dir, table

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores 0.5 or more."""
    rows = cut(quality.features(docs, keep=["doc_id"]))
    model = quality.train(rows, table(spark, sf_dir, "labels"), trusted=crc_mod("doc_id", 3) != quality.HELD_OUT)
    return model.keep(docs, least=0.5)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has, exactly or nearly; those left empty go."""
    out = linededup.dedup_lines(docs, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: by fingerprint, or by five-word similarity of 0.8 or more."""
    return simhash.keep_one(docs, similarity=0.8)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their domain posteriors, rates and copies."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing to target weights", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, by way of Parquet tables in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:  # the table before has been read to the end
            gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{k - 1}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return docs
