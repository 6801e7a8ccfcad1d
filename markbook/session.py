"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if HOME not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (path, HOME) if x)
    return spark


def own_folder(master: str) -> str:
    """A temporary folder for a session without ``spark.checkpoint.dir``, which only driver and executors of one machine share."""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="markbook-")


def checkpointing(spark: SparkSession) -> SparkSession:
    """Sees that ``checkpoint()`` has a folder: that of ``spark.checkpoint.dir``, a temporary one only where it is unset."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own_folder(spark.sparkContext.master))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder of ``spark.checkpoint.dir``, which driver and executors share; below a temporary one only where it is unset."""
    place = spark.conf.get("spark.checkpoint.dir", None) or checkpointing(spark).sparkContext.getCheckpointDir()
    return f"{place.rstrip('/')}/markbook/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: read again, it is the same, whatever executors are lost."""
    path = f"{shared_folder(df.sparkSession)}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
