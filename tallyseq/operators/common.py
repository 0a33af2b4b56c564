"""Helpers of several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where it is unset, only a local session gets one of its own: other executors could not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').removesuffix('/')}/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` with checkpoint() in the shared folder, which ends its lineage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; its cleaner acts on what the driver's collector finds."""
    spark.sparkContext._jvm.System.gc()
