"""The corpus pipeline: toxicity, line deduplication, n-gram join, decontamination, packing.

Each stage takes the documents that its predecessor kept, whole; all but the last return the
columns of ``documents``.  ``run`` writes each stage's result to the shared folder and reads it
again, so a lost executor costs one stage's tasks at most.

Identifiers may be null or repeat: a stage that compares rows then numbers them first, in order of
their ids (null last), and applies its decisions by that number; the others decide row by row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tillroll.llm import op3_ngram_join, op5_toxicity, op6_decontamination, op9_line_dedup, op10_packing
from tillroll.llm.scratch import store


ROW = "__row"


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """``docs`` with a number of each row, ascending with the id.

    That is the id itself where all rows have one of their own; else the numbered rows are
    written, so that the numbers stay the same."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        ids = docs.groupBy("doc_id").count().agg(F.count("*").alias("all"), F.count("doc_id").alias("known"), F.max("count").alias("most")).first()
        if ids["all"] == ids["known"] and (ids["most"] or 1) == 1:
            return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    order = docs.withColumn(ROW, F.monotonically_increasing_id())  # parts equal rows, so that no group of them is one task's
    order = order.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), ROW)
    return store(order.withColumn(ROW, F.monotonically_increasing_id()), label)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled documents among them, does not reject."""
    model = op5_toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op5_toxicity.accepted(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that nearly repeat an earlier one."""
    return op9_line_dedup.dedup(numbered(docs, "numbered"), id_col=ROW, min_words=1).drop(ROW)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of near duplicates (five words, 0.8)."""
    rows = numbered(docs, "numbered")
    groups = op3_ngram_join.linked(rows, id_col=ROW, k=5, percent=80)
    dropped = groups.filter(F.col(ROW) != F.col("component_id")).select(ROW)
    return rows.join(dropped, ROW, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return op6_decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return op10_packing.pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join),
          ("decontamination", decontamination), ("packing", packing)]

#: Similarity joins, a trained model and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
