"""Unions that align columns by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.operators.schema import canonical_casing


def union_order(frames: Sequence[DataFrame]) -> list[str]:
    """The columns of the widest frame (first of equals), then others as they turn up."""
    if not frames:
        return []
    widest = max(frames, key=lambda d: len(d.columns))
    return list(dict.fromkeys([*widest.columns, *(c for d in frames for c in d.columns)]))


def union_all(frames: Mapping[str, DataFrame], mode: str = "union", source: str = "Source File") -> DataFrame:
    """All rows with their source; by the union of columns (missing as blank) or their intersection."""
    parts = canonical_casing(list(frames.values()))
    if mode == "union":
        names = union_order(parts)
    else:
        names = [c for c in union_order(parts) if all(c in d.columns for d in parts)]
        if not names:
            raise ValueError("the sources have no column in common")
    out = None
    for label, df in zip(frames, parts):
        one = df.select(*((F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in names), F.lit(label).alias(source))
        out = one if out is None else out.unionByName(one)
    return out
