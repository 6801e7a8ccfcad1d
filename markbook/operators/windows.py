"""Window operators. Orders must be complete: ties would make a result depend on the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markbook.functions.numbers import quota
from markbook.session import written


def latest(df: DataFrame, entity: str, order: Sequence[Column]) -> DataFrame:
    """The first row of every entity in ``order`` (newest first)."""
    return ranked(df, [entity], order).where("rn = 1").drop("rn")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    """Numbers from 1 inside each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def row_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``__h`` and ``__g``: 128 bits that name a row's values in ``columns``; a null is a value of its own."""
    parts = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return df.withColumns({"__h": F.xxhash64(*parts), "__g": F.xxhash64(F.lit("g"), *parts)})


def duplicate_flag(df: DataFrame, columns: Sequence[str], name: str = "is_duplicate") -> DataFrame:
    """Whether another row equals this one in ``columns``; nulls are equal.

    Only 128-bit hashes are grouped, combined before the shuffle, and only those of several rows are joined: rows meet no
    shuffle where these fit a broadcast, which Spark decides by their size.
    """
    named = row_hash(df, columns)
    several = named.groupBy("__h", "__g").agg(F.count("*").alias("__n")).where("__n > 1").select("__h", "__g", F.lit(True).alias("__dup"))
    return named.join(several, ["__h", "__g"], "left").select(*(f"`{c}`" for c in df.columns), F.coalesce("__dup", F.lit(False)).alias(name))


def deduplicate(df: DataFrame, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of equal ones; pass a descending order to keep the last. Groups are of 128-bit hashes, and each task
    keeps the first of its own rows before the shuffle."""
    return ranked(row_hash(df, columns), ["__h", "__g"], order).where("rn = 1").drop("rn", "__h", "__g")


def distinct_rank(df: DataFrame, c: str, name: str, start: int = 1) -> DataFrame:
    """Dense rank of a column's values over the whole frame.

    Only the distinct values are ordered, not the rows: they are numbered in ranges, each from the count of those before.
    """
    values = df.select(c).where(F.col(c).isNotNull()).distinct()
    parts = written(values.repartitionByRange(c).withColumn("__p", F.spark_partition_id()), "values")  # read twice, by the same ranges
    local = parts.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(c)))
    ahead = parts.groupBy("__p").agg(F.count("*").alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = local.join(ahead.select("__p", "__before"), "__p").select(F.col(c).alias("__v"), (F.col("__r") + F.col("__before") - 1 + start).cast("int").alias(name))
    return df.join(numbered, F.col(c) == F.col("__v"), "left").drop("__v")


def last_of_group(order: Sequence[Column], key: str, within: Sequence[str] = ()) -> Column:
    """Whether the next row in order has another key."""
    w = Window.partitionBy(*within).orderBy(*order)
    return F.lead(F.col(key)).over(w).isNull() | ~F.lead(F.col(key)).over(w).eqNullSafe(F.col(key))


def runs(df: DataFrame, value: str, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """(within, run, value, n): runs of equal neighbours, numbered from 1."""
    w = Window.partitionBy(*within).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("__c", change).withColumn("run", F.sum("__c").over(w))
    return marked.groupBy(*within, "run", value).agg(F.count("*").alias("n"))


def top_share(df: DataFrame, key: str, order: Sequence[Column], share: float = 0.05) -> DataFrame:
    """The first ``quota`` rows of every group."""
    w = Window.partitionBy(key)
    out = ranked(df, [key], order).withColumn("n", F.count("*").over(w))
    return out.withColumn("quota", quota(F.col("n"), share)).where("rn <= quota")


def segments(df: DataFrame, header: Column, order: Sequence[str], within: Sequence[str], name: str = "segment") -> DataFrame:
    """Number of the block that a header row starts; rows before the first header go."""
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(F.coalesce(header, F.lit(False)), 1).otherwise(0)).over(w)).where(F.col(name) > 0)


def blocks(df: DataFrame, starts: Column, ends: Column, order: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Rows from a start row to its end row (``block`` numbered from 1); a block without an end goes."""
    w = Window.partitionBy(*within).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    n = lambda p, frame: F.coalesce(F.sum(F.when(F.coalesce(p, F.lit(False)), 1).otherwise(0)).over(frame), F.lit(0))
    marked = df.withColumns({"block": n(starts, w), "__ends": n(ends, before), "__end": F.coalesce(ends, F.lit(False))})
    inside = marked.where("block > 0")
    first = Window.partitionBy(*within, "block")
    held = inside.withColumn("__e0", F.min("__ends").over(first)).withColumn("__closed", F.max("__end").over(first))
    return held.where((F.col("__ends") == F.col("__e0")) & F.col("__closed")).drop("__ends", "__end", "__e0", "__closed")


def split_at(df: DataFrame, mark: Column, order: Sequence[str], within: Sequence[str], name: str = "part") -> DataFrame:
    """``data`` before the first marked row of a block, ``legend`` from it on."""
    w = Window.partitionBy(*within).orderBy(*order)
    seen = F.max(F.when(F.coalesce(mark, F.lit(False)), 1).otherwise(0)).over(w)
    return df.withColumn(name, F.when(seen == 1, "legend").otherwise("data"))
