"""The document pipeline: each stage works on all that its predecessor kept, written as Parquet and reread."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, exact_dedup, near_copies, toxicity
from lodestone.session import checkpointed, delete, shared_folder, table

#: SQL cannot express the learned stage; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are those of the kept ``rows``; of rows that share both, one."""
    stays = checkpointed(rows.filter("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_text")).agg(F.count("*").alias("_n")))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    met = lambda few: docs.join(stays.filter(few), docs["doc_id"].eqNullSafe(stays["_id"]) & (digest == stays["_text"]))
    if stays.filter("_n > 1").isEmpty():
        return met(F.lit(True)).select(*docs.columns)
    return met(F.col("_n") == 1).union(met(F.col("_n") > 1).dropDuplicates(["_id", "_text"])).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each exact text, the one with the largest doc_id."""
    return _only(docs, exact_dedup.exact_duplicates(docs, exact_dedup.older_half(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets of similarity 0.8, the one with the least doc_id."""
    return _only(docs, near_copies.near_duplicates(docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what lies between them goes to the session's shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            delete(spark, f"{folder}/{number - 1}")
    return docs
