"""Tables written to the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checkpoint_folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def has_checkpoint_folder(spark: SparkSession) -> bool:
    return bool(checkpoint_folder(spark))


_written: list[str] = []


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """The table, written as Parquet below the checkpoint folder and read back.

    It outlives executors and cuts the lineage. ``drop_checkpoints`` deletes what was written.
    """
    spark, folder = df.sparkSession, checkpoint_folder(df.sparkSession)
    if not folder:
        raise ValueError("INVALID_PARAMETER: set spark.checkpoint.dir to use checkpoint=True")
    path = f"{folder.rstrip('/')}/tersa-{os.urandom(8).hex()}"
    _written.append(path)
    void = {f.name for f in df.schema if isinstance(f.dataType, T.NullType)}  # Parquet has no such type
    typed = df.drop(*void)
    typed.write.parquet(path)
    back = spark.read.schema(typed.schema).parquet(path)
    return back.select(*[F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns])


def drop_checkpoints(spark: SparkSession) -> int:
    """Delete the tables that this process has checkpointed; results that still read them are lost. Returns how many."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _written:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    dropped = len(_written)
    _written.clear()
    return dropped
