"""What several of the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import shared_folder

#: Rows in one Python step; a batch from Spark is cut to this, so that lists of long texts stay small.
STEP = 256
#: No column of an input may start with this; operators use it for columns of their own.
OWN = "__llm_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Bound what goes to Python at once by bytes, unless the session says how: texts may be very long."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", "8m"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")):
        if spark.sparkContext.getConf().get(key) is None:
            spark.conf.set(key, value)


def map_rows(df: DataFrame, rows: Callable[[list], Iterable[tuple]], schema: str | StructType) -> DataFrame:
    """Apply ``rows`` to lists of up to STEP input rows, each row a tuple of its columns; it yields output tuples.

    Nothing is kept between lists, so memory is bounded by STEP rows whatever the size of a partition.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                part = whole.slice(at, STEP)
                out = list(rows(list(zip(*(c.to_pylist() for c in part.columns), strict=True))))
                if out:
                    cols = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def text_key(name: str = "text") -> Column:
    """16 bytes that stand for a text (null: empty): half of its SHA-256."""
    return F.unhex(F.substring(F.sha2(text_of(name), 256), 1, 32))


def input_rows(df: DataFrame) -> int:
    return df.select(F.lit(1)).count()


def planned_bytes(df: DataFrame) -> int:
    """The size that Spark's planner takes ``df`` for: of tables their files', of joins often far too much, without a job."""
    try:
        return min(1 << 60, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    except ValueError:  # a product over many joins, with more digits than Python reads
        return 1 << 60


def tasks_for(spark: SparkSession, rows: int, a_task: int = 10_000) -> int:
    """Tasks for what grows with ``rows``: as many as there are cores, and one for each ``a_task`` rows beyond that."""
    return max(spark.sparkContext.defaultParallelism, rows // a_task)


def checkpointed(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, with its lineage cut; in ``tasks`` files at most, as every file costs a process or two."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return (df if tasks is None else df.coalesce(tasks)).checkpoint()


def dropped(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system, whichever that is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def apart(df: DataFrame, key: str) -> DataFrame:
    """``df``, grouped by ``key``, with that key behind an expression: a join by it then shuffles both sides, and Spark can split a hot key on the other one.

    Without that a join takes the groups where they lie, and all rows of a hot key go to one task."""
    return df.withColumn(key, F.array_min(F.array(key)))
