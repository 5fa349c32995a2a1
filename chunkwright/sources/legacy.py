"""An index of segments as it was kept before: lines of JSON, migrated to Parquet once."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..operators import store

INDEX = "id string, segment_id long, offset long, raw_len long, stored_len long, compressed boolean"


def load_index(spark: SparkSession, folder: str, lines: str) -> DataFrame:
    """The segment index in ``folder``; where there is none yet, that of ``lines`` (JSON) is
    written there first, each id once, sorted by id. Lines that aren't entries are passed over. With neither the index is empty."""
    if not os.path.exists(os.path.join(folder, "_SUCCESS")):
        if not os.path.exists(lines):
            return spark.createDataFrame([], INDEX)
        rows = spark.read.schema(INDEX).json(lines).where("id IS NOT NULL AND segment_id IS NOT NULL").dropDuplicates(["id"])
        store.sorted_by_id(rows).write.mode("overwrite").parquet(folder)
    return spark.read.schema(INDEX).parquet(folder)
