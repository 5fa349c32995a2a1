"""What driver and executors share: the folder that the cluster names, and batches of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset one below /tmp is taken, but only where all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or "/tmp/checkpoints"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def bounded_batches(spark: SparkSession) -> None:
    """What goes to Python at once is bounded by bytes, unless the session says how: rows hold whole chunks."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", "64m"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")):
        if spark.sparkContext.getConf().get(key) is None:
            spark.conf.set(key, value)
