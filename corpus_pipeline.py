"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next.

Every row is judged by its own text: null texts fail the quality rules; rows with a null doc_id are judged, scanned and
packed like others but are nobody's near duplicate; rows under one doc_id with different texts are different documents,
of which the near-duplicate stage keeps or drops all of one id together. An empty table stays empty. Columns beyond
doc_id and text pass through, n_chars follows the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import delete_folder, shared_folder
from tallyspark.llm.decontamination import drop_contaminated
from tallyspark.llm.jaccard_join import drop_near_duplicates
from tallyspark.llm.packing import pack_documents
from tallyspark.llm.quality_rules import drop_rejected
from tallyspark.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, those with null or empty texts among them."""
    return drop_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 on five-word shingles the smallest doc_id stays; rows with a
    null doc_id stay."""
    return drop_near_duplicates(docs, size=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a shorter item whole, go, whatever their doc_id."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind, whatever the doc_id; n_chars, where there is one, follows the new text."""
    clean = redact(docs)
    return (clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, each with its place in a sequence; null doc_ids among them."""
    return pack_documents(docs)


#: In this order; all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("best_fit_packing", packing),
]
#: Packing is no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written to the shared folder and read again, and removed when the
    next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            delete_folder(spark, f"{folder}/{number - 1}-{STAGES[number - 1][0]}")
    return docs
