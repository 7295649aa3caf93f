"""The training-data pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, packing."""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatwise.llm import decontamination, jaccard_join, language_id, line_dedup, packing
from beatwise.llm.tables import remainder, table
from beatwise.session import shared_folder

#: A document stays if the words' mean posterior of its language is at least this.
LANGUAGE_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose words settle on no language."""
    model = language_id.train(docs.filter(remainder("doc_id", 4) != 2).select("text", "lang"))
    return language_id.keep(docs, model, LANGUAGE_SCORE)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of runs of lines; a document of which nothing is left goes."""
    left = line_dedup.dedup(docs).filter("lines_deleted = 0 or trim(text) <> ''")
    changed = F.when(F.col("lines_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component."""
    return jaccard_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    bad = decontamination.report(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", known_language), ("line_dedup", without_repeated_lines), ("jaccard_join", one_of_each_group),
          ("decontamination", without_benchmark), ("packing", packed)]
#: Learned models and token merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of ``documents`` after all stages; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(docs.schema).parquet(f"{folder}/{name}")
    return docs
