"""Workbooks by path, as frames of named columns, and reports as one workbook; see ``sheetreader`` and ``sheetwriter``."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.operators.schema import clean_name, unique_names
from markbook.sources import sheetreader
from markbook.sources.sheetwriter import Sheet, to_workbook, write_workbooks  # noqa: F401  (to_workbook is part of this interface)


def literal(path: str) -> str:
    """A path as Spark's readers take it, without patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's readers name it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def _numbered(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, _file_no) of the given paths, which the caller has as a list."""
    return F.broadcast(spark.createDataFrame([(qualified(spark, p), i) for i, p in enumerate(paths)], "path string, _file_no int"))


def raw(spark: SparkSession, paths: Sequence[str], sheet: str = "first", blank: str = "null") -> DataFrame:
    """_file, _file_no, _sheet, _sheet_no, _row_no, cells of all readable files, headers included; ``sheet`` is ``first`` or ``*``."""
    got = sheetreader.read(spark, [literal(p) for p in paths], sheet == "*", "" if blank == "empty" else None).rows
    named = got.join(_numbered(spark, paths), "path")
    return named.select(F.element_at(F.split("path", "/"), -1).alias("_file"), "_file_no", F.col("sheet").alias("_sheet"), F.col("sheet_no").alias("_sheet_no"), "_row_no", "cells")


def sheets(rows: DataFrame) -> dict[tuple[str, str], DataFrame]:
    """A frame of named text columns for each (file, sheet); headers are the first rows, one a sheet.

    Of several files of one name the later ones are named with ``_2``, ``_3``, ...
    """
    heads = rows.where("_row_no = 0").orderBy("_file_no", "_sheet_no").collect()
    files = {h._file_no: h._file for h in heads}
    files = dict(zip(files, unique_names(files.values())))
    out = {}
    for h in heads:
        names = unique_names([clean_name(c or f"Column{i + 1}") for i, c in enumerate(h.cells)])
        own = rows.where((F.col("_file_no") == h._file_no) & (F.col("_sheet_no") == h._sheet_no) & (F.col("_row_no") > 0))
        out[files[h._file_no], h._sheet] = own.select(*(F.try_element_at("cells", F.lit(i + 1)).alias(n) for i, n in enumerate(names)), "_file_no", "_sheet_no", "_row_no")
    return out


def unreadable(rows: DataFrame, paths: Sequence[str]) -> list[str]:
    """The files, in the order of ``paths`` as given to ``raw``, that are no workbooks."""
    got = {r[0] for r in rows.select("_file_no").distinct().collect()}
    return [p for i, p in enumerate(paths) if i not in got]


def write_workbook(path: str, frames: Mapping[str, DataFrame]) -> None:
    """K1-K7: one workbook of several sheets, each a frame in its order. Frames beyond the rows of a sheet are refused."""
    folder, _, name = path.rpartition("/")
    write_workbooks(folder, {k: Sheet(df) for k, df in frames.items()}, name=name.removesuffix(".xlsx"))
