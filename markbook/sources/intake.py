"""A folder taken in by steps: each step reads only the files that no step before has read.

The manifest is a table of files by path, size and time, a folder a step. A step lists the folder (Spark reads no contents for
that), leaves out what the manifest has, and records the rest when the caller says that they are read. A step's folder is
named by its files, so a step that is done again, or twice at once, records the same thing in the same place.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["path", "length", "modified"]
KIND = "path string, length long, modified timestamp"


class Step(NamedTuple):
    """The files of one step, and where the manifest will name them."""

    files: DataFrame
    place: str
    n: int

    def paths(self) -> list[str]:
        """For Spark's readers, which take a list."""
        return [r.path for r in self.files.select("path").orderBy("path").toLocalIterator()]

    def record(self) -> None:
        """The step's files are read; they are left out from now on."""
        if self.n:
            self.files.write.mode("overwrite").parquet(self.place)


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length, modified of the files below a folder; names alone, no contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def recorded(spark: SparkSession, manifest: str) -> DataFrame:
    """All files of all steps."""
    place = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], KIND)
    return spark.read.schema(KIND).option("recursiveFileLookup", "true").parquet(manifest)


def step(spark: SparkSession, folder: str, manifest: str, pattern: str = "*") -> Step:
    """The next step: files that are new, or changed in size or time."""
    files = listed(spark, folder, pattern).join(recorded(spark, manifest), KEYS, "left_anti")
    name = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*KEYS).cast("decimal(38,0)")).alias("h")).first()
    return Step(files, f"{manifest}/step-{name.n}-{name.h}", name.n)
