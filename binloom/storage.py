"""Cutting lineage into the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    A session that names none has one in local mode only, where driver and executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "/tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder; later reads survive lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame) -> DataFrame:
    """``cut`` for the state of a loop that joins it with itself in every round.

    Spark keeps an estimate of a checkpoint's size and multiplies those of a join's sides, so that its digits would double
    with each round; rows that come as an RDD have none.
    """
    held = cut(df)
    return DataFrame(df.sparkSession._jsparkSession.createDataFrame(held._jdf.javaRDD(), held._jdf.schema()), df.sparkSession)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` after a cut, and its number of rows, counted on the way."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return out, seen.get["rows"]
