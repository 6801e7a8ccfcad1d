"""G1: merge of mark sheets and duplicate audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.functions.text import clean_cell, group_label
from markbook.operators.filters import drop_empty
from markbook.operators.schema import clean_names
from markbook.operators.sets import union_all
from markbook.operators.windows import deduplicate, duplicate_flag

SOURCE = "Source File"


def cleaned(df: DataFrame) -> DataFrame:
    """Clean headers and cells, no blank rows."""
    df = clean_names(drop_empty(df))
    return drop_empty(df.select(*(clean_cell(F.col(f"`{c}`")).alias(c) for c in df.columns)))


def merge(frames: Mapping[str, DataFrame], keys: Sequence[str] | None = None, mode: str = "union") -> DataFrame:
    """All rows with their source and ``is_duplicate`` over ``keys`` (default: all columns but the source)."""
    rows = union_all({k: cleaned(df) for k, df in frames.items()}, mode)
    return duplicate_flag(rows, list(keys or [c for c in rows.columns if c != SOURCE]))


def duplicate_report(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The duplicates with their group's label, by group, then source."""
    return merged.where("is_duplicate").withColumn("Duplicate Group", group_label(list(keys))).orderBy("Duplicate Group", SOURCE)


def without_duplicates(merged: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """One row of each group, the first or last in ``order``."""
    side = F.asc if keep == "first" else F.desc
    return deduplicate(merged, list(keys), [side(o) for o in order])
