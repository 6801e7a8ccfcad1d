"""Grouped and global aggregates, with sums of nothing as 0 and ratios of nothing as 0."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.functions.numbers import number, percent, quota
from markbook.functions.text import strip


def sums(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column], drop_null_keys: bool = True) -> DataFrame:
    """A1, A2: sums by key (no keys: one row)."""
    for k in keys if drop_null_keys else ():
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in measures.items()))


def completion(df: DataFrame, keys: Sequence[str], whole: Column, done: Column, places: int = 1) -> DataFrame:
    """A1 with A3: keys, total, completed, completion_pct."""
    out = sums(df, keys, {"total": whole, "completed": done})
    return out.withColumn("completion_pct", percent(F.col("completed"), F.col("total"), places))


def frequency(df: DataFrame, c: str, keep_null: bool = False) -> DataFrame:
    """(value, n) of a trimmed column, most frequent first."""
    v = F.when(F.col(c).isNotNull(), strip(F.col(c)))
    out = df.select(v.alias("value"))
    return (out if keep_null else out.where("value is not null and value <> ''")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def with_total(df: DataFrame, key: str, measures: Mapping[str, Column], total: str = "TOTAL", missing: str = "[UNMATCHED]") -> DataFrame:
    """Measures by key and a row for all; blank keys under ``missing``."""
    label = F.coalesce(F.nullif(strip(F.col(key)), F.lit("")), F.lit(missing)).alias(key)
    named = df.withColumn(key, label)
    return named.rollup(key).agg(F.grouping(key).alias("__all"), *(c.alias(n) for n, c in measures.items())).withColumn(key, F.when(F.col("__all") == 1, F.lit(total)).otherwise(F.col(key))).drop("__all")


def summary(df: DataFrame, keys: Sequence[str], entity: str, value: str) -> DataFrame:
    """Entities, sum, max and mean (2 places) of a value by key."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.countDistinct(entity).alias("n_entities"), F.sum(v).alias("total"), F.max(v).alias("largest"), F.round(F.avg(v), 2).alias("mean"))


def listed(df: DataFrame, keys: Sequence[str], item: Column, order: Sequence[str], sep: str = ", ", distinct: bool = False) -> DataFrame:
    """Keys, n and the items of a group in order, as one text."""
    if distinct:
        return df.groupBy(*keys).agg(F.countDistinct(item).alias("n"), F.array_join(F.array_sort(F.collect_set(item)), sep).alias("items"))
    packed = F.sort_array(F.collect_list(F.struct(*order, item.alias("__item"))))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.transform(packed, lambda s: s["__item"]), sep).alias("items"))


def numeric_profile(df: DataFrame, c: str) -> DataFrame:
    """Mean and maximum of a text column's numbers."""
    n = number(F.col(c))
    return df.agg(F.round(F.avg(n), 2).alias("mean"), F.max(n).alias("largest"))


def change_counts(df: DataFrame, keys: Sequence[str], before: Column, after: Column) -> DataFrame:
    """How many went up, down or stayed."""
    return df.groupBy(*keys).agg(F.count_if(after > before).alias("up"), F.count_if(after < before).alias("down"), F.count_if(after == before).alias("same"))


def rule_of_share(df: DataFrame, keys: Sequence[str], hit: Column, least: float = 0.5) -> DataFrame:
    """Rows, hits, share and whether the share is above ``least`` (strictly)."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    share = F.coalesce(F.try_divide("hits", "n"), F.lit(0.0))
    return out.withColumn("share", F.round(share, 6)).withColumn("eligible", share > least)


def check_totals(df: DataFrame, keys: Sequence[str], parts: Column, whole: Column, tolerance: float = 0.01) -> DataFrame:
    """Sums of parts and wholes by key, and whether they differ."""
    out = df.groupBy(*keys).agg(F.sum(parts).alias("parts"), F.sum(whole).alias("whole"))
    return out.withColumn("mismatch", F.abs(F.col("parts") - F.col("whole")) >= tolerance)


def quartiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Five-number summary, exact."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*keys).agg(F.min(value).alias("low"), q.alias("q"), F.max(value).alias("high")).select(
        *keys, "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high"
    )


def source_audit(frames: Mapping[str, DataFrame]) -> list[dict]:
    """Per source rows, columns, headers and whether it is the widest (first of equals)."""
    widest = max(frames, key=lambda k: len(frames[k].columns), default=None)
    return [{"source": k, "rows": df.count(), "columns": len(df.columns), "is_master": k == widest, "headers": ", ".join(df.columns)} for k, df in frames.items()]


def quotas(df: DataFrame, key: str, share: float = 0.05) -> DataFrame:
    """Size and quota of every group."""
    return df.groupBy(key).agg(F.count("*").alias("n")).withColumn("quota", quota(F.col("n"), share))


def common_groups(df: DataFrame, canon: str, raw: str, programme: str) -> DataFrame:
    """Canonical names with several spellings, programmes or rows."""
    out = df.groupBy(canon).agg(F.countDistinct(raw).alias("spellings"), F.countDistinct(programme).alias("programmes"), F.count("*").alias("n"))
    return out.withColumn("is_common", (F.col("spellings") > 1) | (F.col("programmes") > 1) | (F.col("n") > 1))


def first_value(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The first non-null value in order."""
    return df.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias(value))
