"""Corpus pipeline: documents to packed training windows in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``. A stage works on all that its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm import decontaminate, jaccard_join, langid, packing, pii
from traceframe.llm.common import BATCH_ROWS, columns, table
from traceframe.session import ensure_checkpoint_dir


def whole(docs: DataFrame) -> Column:
    """A document's columns as one, apart from those that operators add."""
    return F.struct(*columns(docs)).alias("doc")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter.
    From here on texts go to Python in small batches."""
    for k, v in BATCH_ROWS.items():
        spark.conf.set(k, v)
    net = langid.train(docs.where(~langid.held_out())) or langid.ByteNet(["any"])  # without labels, letters alone decide
    return langid.predict(docs, net, [whole(docs)]).where(F.col("lang_pred") != langid.UNKNOWN).select("doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, Jaccard 0.8), the one with the least id."""
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), [whole(docs)])
    return found.where(~F.col("contaminated")).select("doc.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text."""
    found = pii.spans(docs, pii.train(docs), [whole(docs)])
    text = F.col("doc.text")
    masked = F.col("doc").withField("text", pii.masked(text, F.col("spans")))
    if "n_chars" in docs.columns:
        masked = masked.withField("n_chars", F.length(pii.masked(text, F.col("spans"))).cast(docs.schema["n_chars"].dataType))
    return found.select(F.when(F.size("spans") > 0, masked).otherwise(F.col("doc")).alias("doc")).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of all that is left, one row for each piece with its ids."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_copies", near_copies), ("decontamination", decontamination),
          ("personal_data", personal_data), ("packing", pack)]

#: Trained models, metric joins and tokenizers have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
