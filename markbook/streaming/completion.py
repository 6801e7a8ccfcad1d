"""Completion figures over an event stream. An extra: the reference behaviour has no streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.functions.numbers import percent


def windowed_completion(events: DataFrame, time: str, keys: list[str], done: Column, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, keys, total, completed, completion_pct) by tumbling window; rows later than ``late`` go."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = rows.groupBy(F.window("__t", length).alias("w"), *keys).agg(F.count("*").alias("total"), F.count_if(done).alias("completed"))
    return out.select(F.col("w.start").alias("start"), *keys, "total", "completed", percent(F.col("completed"), F.col("total")).alias("completion_pct"))


def session_activity(events: DataFrame, time: str, entity: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, entity, n): bursts of an entity's events without a pause of ``gap``."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = rows.groupBy(F.session_window("__t", gap).alias("w"), entity).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), entity, "n")
