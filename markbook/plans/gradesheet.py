"""Grade-sheet pages as profiles, wide and long subjects and semester history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.functions import extract as E
from markbook.functions.numbers import percent
from markbook.operators.aggregates import frequency, numeric_profile
from markbook.operators.reshape import exploded, numbered_wide


def profiles(pages: DataFrame, text: str = "text", grid: str | None = None) -> DataFrame:
    """One row a page (doc, page, text, optional grid): header fields, ``subjects`` and the extraction status."""
    rows = pages.select("doc", "page", *(c.alias(k) for k, c in E.grade_sheet_header(F.col(text)).items()), E.subjects(F.col(text), F.col(grid) if grid else None).alias("subjects"))
    return rows.withColumn("status", E.extraction_status(F.size("subjects"), F.col("sap_no")))


def long_subjects(found: DataFrame) -> DataFrame:
    """M1: a row a subject; grade F is failed."""
    return exploded(found, ["doc", "page", "sap_no", "name"], "subjects").withColumn("failed", F.col("grade") == "F")


def wide_subjects(found: DataFrame, n: int) -> DataFrame:
    """M1: ``Sub1 code`` ... of at most ``n`` subjects; n is the widest page of the report."""
    return numbered_wide(found, ["doc", "page", "sap_no", "name"], "subjects", ["code", "title", "credits", "total", "grade"], n)


def widest(found: DataFrame) -> int:
    return found.agg(F.coalesce(F.max(F.size("subjects")), F.lit(0))).first()[0]


def figures(found: DataFrame) -> dict[str, DataFrame]:
    """A7, A12, A23."""
    good = F.count_if(F.lower("remark") == "successful")
    counts = found.agg(F.count("*").alias("pages"), good.alias("successful"), F.count_if(F.col("status") != "OK").alias("to_review")).withColumn("success_pct", percent(F.col("successful"), F.col("pages")))
    return {"counts": counts, "sgpa": numeric_profile(found, "sgpa"), "grades": frequency(long_subjects(found), "grade"), "remarks": frequency(found, "remark")}
