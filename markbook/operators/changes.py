"""A mapping edited by hand, as a log of changes: compacted to intervals of validity, and applied as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.operators.scan import Ordered


def compacted(edits: DataFrame, key: str, value: str, at: str, seq: str) -> DataFrame:
    """(key, value, valid_from, valid_to): one row for every time that a key holds a value; valid_to is null while it holds.

    ``edits`` (key, value, at, seq): a null or blank value deletes. Of edits of a key at one time the last by ``seq`` counts,
    and one that changes nothing is none. Edits are scanned newest first in one order of keys and times, so a key that most
    edits are about is spread like any other.
    """
    held = F.when(F.trim(F.col(value)) != "", F.col(value))
    last = edits.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).alias("key"), F.col(at).alias("at")).agg(F.max_by(F.struct(held.alias("v")), seq).alias("s"))
    forward = Ordered(last.select("key", "at", F.col("s.v").alias("value")), ["key", "at"]).previous("before", F.struct("key", "value")).rows
    same_key = F.col("before").isNotNull() & (F.col("before.v.key") == F.col("key"))
    changes = forward.where(~same_key & F.col("value").isNotNull() | same_key & ~F.col("before.v.value").eqNullSafe(F.col("value"))).select("key", "at", "value", (-F.unix_micros(F.col("at").cast("timestamp"))).alias("newest"))
    ends = Ordered(changes, ["key", "newest"]).previous("after", F.struct("key", "at")).rows
    until = F.when(F.col("after").isNotNull() & (F.col("after.v.key") == F.col("key")), F.col("after.v.at"))
    return ends.where("value is not null").select("key", "value", F.col("at").alias("valid_from"), until.alias("valid_to"))


def as_of(mapping: DataFrame, when: Column) -> DataFrame:
    """(key, value) of a compacted mapping at a time."""
    return mapping.where((F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when))).select("key", "value")


def overridden(df: DataFrame, key: str, mapping: DataFrame, name: str, otherwise: Column) -> DataFrame:
    """``df`` with ``name``: the mapping's value of its key, else ``otherwise``. ``mapping`` (key, value) has a key once."""
    met = mapping.select(F.col("key").alias("__key"), F.col("value").alias("__value"))
    return df.join(met, F.col(f"`{key}`") == F.col("__key"), "left").withColumn(name, F.coalesce("__value", otherwise)).drop("__key", "__value")
