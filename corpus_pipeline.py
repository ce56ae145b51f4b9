"""A training corpus from raw documents in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the five columns of documents, whatever other columns come in, and an empty table for an empty
one. Texts of any length are taken whole. Repeated rows and rows without an id are documents like others, judged each by
its own text; only in near_dedup rows that share an id stay or go together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import broadcast_if_few, checkpoint, ensure_checkpoints, key_of
from turnloom.llm.decontaminate import decontaminate
from turnloom.llm.language import UNKNOWN, identify
from turnloom.llm.minhash import near_duplicates
from turnloom.llm.mixing import emit
from turnloom.llm.substring import substring_dedup
from turnloom.shared import forget

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, null and empty ones among them. One whose lang is null gets the predicted one, if any
    language could be learned."""
    out = identify(docs.select(COLUMNS), docs).where(F.col("text").rlike(r"\p{L}"))
    named = F.when(F.col("lang_pred") != UNKNOWN, F.col("lang_pred"))
    return out.withColumn("lang", F.coalesce("lang", named)).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of the least id stays; no id
    counts as the least. Texts without words are no duplicates of anything."""
    gone = checkpoint(near_duplicates(docs).where(~F.col("kept")).select(key_of("doc_id").alias("gone")).distinct())
    return docs.select(COLUMNS).join(broadcast_if_few(gone), key_of("doc_id") == F.col("gone"), "left_anti")


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go. A text that loses none stays as it is, a null one too; one that loses all goes, as
    the later of two equal ones of 20 words or more does."""
    out = substring_dedup(docs, carry=("lang", "source", "n_chars"), as_is=True)
    lost = F.col("n_removed") > 0
    out = out.where(~lost | (F.col("n_removed") < F.col("n_words")))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(lost, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are a twentieth or more go. Null and empty texts stay."""
    return decontaminate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy, numbered by copy. A null source is one of its own; rows that share an id draw one by one."""
    return emit(docs.select(COLUMNS))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("benchmark_decontamination", benchmark_decontamination), ("source_mixing", source_mixing)]

#: Language ID is a trained model and near dedup an iterated search: SQL expresses neither. tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each writes Parquet to the shared folder, which the next one reads. What no later
    stage reads is deleted."""
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            forget(spark, before)
        before = f"{folder}/{name}"
    return docs
