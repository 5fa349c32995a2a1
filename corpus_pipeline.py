"""The corpus pipeline: language ID, near-dedup, substring dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return
the columns of ``docs``. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.llm import common, language, near_dedup, packing, secret_scan, substring_dedup
from chunkwright.sources.shared import shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are no language's text (null, or without a letter) go. The model is trained on ``docs``; where no row has a label there is none, and all stay."""
    model = language.train(docs)
    if not model.families:
        return docs

    def judged(batch: list) -> list[tuple]:
        return [row for row in batch if model.predict(row[at])[0] != language.REJECTED]

    at = docs.columns.index("text")
    return common.map_rows(docs, judged, docs.schema)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return near_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; a document that consists of such passages goes."""
    rows = substring_dedup.substring_dedup(docs).where((F.col("__llm_removed_chars") == 0) | (F.trim("text") != ""))
    return _with_length(rows, docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    vocabulary, at = secret_scan.default_vocabulary(), docs.columns.index("text")

    def redacted(batch: list) -> list[tuple]:
        return [row if row[at] is None else (*row[:at], secret_scan.redact(row[at], vocabulary), *row[at + 1 :]) for row in batch]

    return _with_length(common.map_rows(docs, redacted, docs.schema), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


def _with_length(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``docs``' columns, with ``n_chars`` of the new text where there is such a column."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


STAGES = [("language_id", language_id), ("near_dedup", near_duplicates), ("substring_dedup", repeated_passages), ("secret_scan", secrets), ("packing", pack)]

#: Classes, models and tokens have no SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and read again; what a stage has read is deleted when its own rows are there."""
    docs = common.table(spark, sf_dir, "documents")
    folder, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            common.dropped(spark, f"{folder}/{last}")
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
