"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.session import checkpointing


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; the session's own temporary one where none is named, but not on a cluster."""
    place = spark.conf.get("spark.checkpoint.dir", None) or checkpointing(spark).sparkContext.getCheckpointDir()
    return place.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/markbook/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


#: Rows of numbers up to which a table is kept in one partition, so that small steps need no shuffle.
SMALL = 100_000
#: Rows of numbers up to which a table is broadcast.
MOST_BROADCAST = 200_000


class Counted:
    """A written table with its number of rows."""

    def __init__(self, df: DataFrame, name: str):
        table = written(df, name)
        self.n = table.count()
        self.df = table.coalesce(1) if self.n <= SMALL else table

    def side(self, df: DataFrame | None = None) -> DataFrame:
        """The table (or ``df``, made of it row by row) as a side of a join: broadcast if it is of a bounded size."""
        df = self.df if df is None else df
        return F.broadcast(df) if self.n <= MOST_BROADCAST else df


def spread(pairs: Counted, each: int = 2000) -> int:
    """Partitions for work over pairs: about ``each`` pairs a task, the shuffle partitions at most."""
    most = int(pairs.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, pairs.n // each))


def clear(spark: SparkSession) -> None:
    """Deletes what this application has written, once no result that reads it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/markbook/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
