"""Text and XML documents as frames; see the functions for the inventory's names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.functions.dates import HOLIDAY_FORMATS, parsed
from markbook.functions.text import strip
from markbook.operators.reshape import cell_positions
from markbook.sources import spreadsheetml


def found_files(spark: SparkSession, folder: str, pattern: str = "*.xls*") -> list[str]:
    """Files below a folder, sorted."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return sorted(r[0] for r in listed.select("path").collect())


def page_lines(pages: DataFrame, keys: Sequence[str] = ("doc", "page"), text: str = "text") -> DataFrame:
    """(keys, line_no, text): the lines of page texts, from 1."""
    return pages.select(*keys, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line")).select(*keys, (F.col("line_no") + 1).alias("line_no"), F.col("line").alias("text"))


def spreadsheet_xml(spark: SparkSession, path: str) -> DataFrame:
    """(row, column, text, merge_across, merge_down) of the first worksheet of a SpreadsheetML file, sparse cells placed."""
    return spreadsheetml.cells(spark, path).drop("path", "sheet_no")


def column_widths(spark: SparkSession, path: str) -> DataFrame:
    """(column, width) from the column elements, spans repeated."""
    kind = "Column array<struct<`_ss:Index`: int, `_ss:Span`: int, `_ss:Width`: double>>"
    columns = spark.read.schema(kind).format("xml").option("rowTag", "Table").load(path).limit(1).select(F.col("Column").alias("c"))
    cells = F.transform("c", lambda x: F.struct(x["_ss:Index"].alias("index"), x["_ss:Span"].alias("span")))
    each = columns.select(F.explode(F.arrays_zip(F.col("c").alias("c"), cell_positions(cells).alias("at"))).alias("z"))
    every = F.explode(F.sequence(F.col("z.at"), F.col("z.at") + F.coalesce(F.col("z.c.`_ss:Span`"), F.lit(0))))
    return each.select(every.alias("column"), F.col("z.c.`_ss:Width`").alias("width"))


def holidays(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(days, rejects) of a text with one date a line."""
    lines = spark.range(1).select(F.explode(F.split(F.lit(text), r"\r?\n")).alias("line")).select(strip(F.col("line")).alias("line")).where("line <> ''")
    both = lines.withColumn("day", parsed(F.col("line"), *HOLIDAY_FORMATS))
    return both.where("day is not null").select("day").distinct(), both.where("day is null").select("line")


def manual_groups(spark: SparkSession, groups: dict[str, str]) -> DataFrame:
    """(description, group) as edited by hand; blank groups are none."""
    return spark.createDataFrame([(k, v) for k, v in groups.items() if v and v.strip()], "description string, group string")
