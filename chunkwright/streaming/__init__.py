"""Structured Streaming: chunks as they are stored, locks as they are taken."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators import chunking, locks, store

OUTCOMES = "path string, seq long, op string, owner string, outcome string, holder string"


def stream(spark: SparkSession, path: str, files_a_trigger: int = 16) -> DataFrame:
    """New Parquet files under ``path``, a bounded number at a time. ``path`` may also be one file, which a stream takes as a pattern only."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def lock_outcomes(ops: DataFrame) -> DataFrame:
    """A stream of lock operations (``path``, ``owner``, ``op``, ``seq``) as outcomes; the state of a path is its holder.

    Within a batch a path's operations go by seq; batches go in the order they come.
    """

    def applied(key: tuple, frames, state: GroupState):  # noqa: ANN001, ANN202
        holder = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["seq", "owner", "op"])
        out = []
        for op in rows.itertuples():
            outcome, holder = locks.step(holder, op.op, op.owner)
            out.append((key[0], op.seq, op.op, op.owner, outcome, holder))
        state.update((holder,))
        yield pd.DataFrame(out, columns=["path", "seq", "op", "owner", "outcome", "holder"])

    return ops.groupBy("path").applyInPandasWithState(applied, OUTCOMES, "holder string", "append", "NoTimeout")


def drained(frame: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all there is into Parquet below ``folder``, and read that."""
    run = f"{folder}/stream-{uuid.uuid4().hex}"
    frame.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.read.parquet(f"{run}/out")


def new_chunks(texts: DataFrame, folder: str) -> DataFrame:
    """Store the line chunks of a stream of texts (``path``, ``text``), batch by batch: each takes in what the store lacks, so a batch that is
    run again adds nothing. Returns the store."""
    run = f"{folder}/chunks-{uuid.uuid4().hex}"
    spark = texts.sparkSession
    empty = spark.createDataFrame([], "id string, raw_len long, data binary")
    empty.write.parquet(f"{run}/store/batch=-1")

    def put(batch: DataFrame, number: int) -> None:
        rows = chunking.line_chunks(batch).select("id", F.col("len").alias("raw_len"), F.col("line").cast("binary").alias("data"))
        have = batch.sparkSession.read.parquet(f"{run}/store").where(F.col("batch") != number)
        store.new_chunks(rows, have).write.mode("overwrite").parquet(f"{run}/store/batch={number}")

    texts.writeStream.foreachBatch(put).option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{run}/store").drop("batch")
