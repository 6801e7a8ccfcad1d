"""Lookups and exception reports. Every lookup says which of equal keys wins; blank results are for report edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], wins: str = "last") -> DataFrame:
    """One row a key, by a complete order. The rest of a row travels as one struct through a combined aggregate."""
    rest = [c for c in df.columns if c not in set(keys)]
    pick = F.max_by if wins == "last" else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*(f"`{c}`" for c in rest)), F.struct(*order)).alias("__r"))
    return best.select(*keys, *(F.col(f"__r.`{c}`").alias(c) for c in rest))


def lookup(df: DataFrame, side: DataFrame, keys: Sequence[str], values: Mapping[str, str], order: Sequence[str], wins: str = "last", default: object = None) -> DataFrame:
    """Left join on a side with one row a key; ``values``: new name by column of the side."""
    small = one_per_key(side.select(*keys, *dict.fromkeys([*values, *(o for o in order if o not in keys)])), keys, order, wins)
    out = df.join(small.select(*keys, *(F.col(k).alias(v) for k, v in values.items())), list(keys), "left")
    return out if default is None else out.withColumns({v: F.coalesce(F.col(v), F.lit(default)) for v in values.values()})


def flagged_lookup(df: DataFrame, side: DataFrame, keys: Sequence[str], values: Mapping[str, str], order: Sequence[str], flag: str = "incomplete") -> DataFrame:
    """As ``lookup``, first row wins, with Yes/No whether the key was missing."""
    tagged = side.withColumn("__hit", F.lit(1))
    out = lookup(df, tagged, keys, {**values, "__hit": "__hit"}, order, "first")
    return out.withColumn(flag, F.when(F.col("__hit").isNull(), "Yes").otherwise("No")).drop("__hit")


def unmatched(df: DataFrame, side: DataFrame, keys: Sequence[str], show: Sequence[str]) -> DataFrame:
    """Distinct ``show`` of the rows whose key the side lacks."""
    return df.join(side.select(*keys).distinct(), list(keys), "left_anti").select(*show).distinct()


def first_of_kinds(kind: str, value: Column, wanted: Mapping[str, str], order: Sequence[str]) -> list[Column]:
    """Aggregates: the first value of each wanted kind (kind: new name)."""
    first = lambda k: F.min_by(F.when(F.col(kind) == k, value), F.when(F.col(kind) == k, F.struct(*order)))
    return [first(k).alias(v) for k, v in wanted.items()]


def siblings(df: DataFrame, keys: Sequence[str], kind: str, value: str, wanted: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    """Per key the first value of each wanted kind (kind: new name), without a self-join."""
    return df.groupBy(*keys).agg(*first_of_kinds(kind, F.col(value), wanted, order))


def against_baseline(df: DataFrame, keys: Sequence[str], base: Column, value: str, order: Sequence[str], name: str = "baseline") -> DataFrame:
    """On every row the first ``value`` of the group's baseline row."""
    w = Window.partitionBy(*keys)
    return df.withColumn(name, F.min_by(F.when(base, F.col(value)), F.when(base, F.struct(*order))).over(w))


def preferred(df: DataFrame, *candidates: str, name: str) -> DataFrame:
    """The first candidate that says something."""
    return df.withColumn(name, F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in candidates)))


#: Rows of ``pairs_within`` that a task pairs off, about.
ROWS_EACH = 250_000


def pairs_within(df: DataFrame, group: str, node: str) -> DataFrame:
    """The distinct node pairs a < b that share a group. Pairs of a group are what a conflict is.

    Rows are counted first and dealt by group in partitions of about ROWS_EACH, so that a task's memory doesn't grow with the table:
    pairs are combined where they are made, and no partition is merged with others by its few bytes, which its pairs outgrow.
    """
    rows = df.select(group, node).where(F.col(group).isNotNull() & F.col(node).isNotNull())
    n = rows.count()
    if n > ROWS_EACH:
        usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(max(usual, -(-n // ROWS_EACH)), group)
    one = rows.distinct()
    a, b = one.select(group, F.col(node).alias("a")), one.select(group, F.col(node).alias("b"))
    return a.join(b, group).where("a < b").select("a", "b").distinct()
