"""Rank lists by programme."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markbook.functions.numbers import first_number, number, quota
from markbook.operators.filters import with_key
from markbook.operators.schema import bind

WANTED = {"Student No": (), "Student Name": (), "Program Name": (), "CGPA": (), "Rank": ()}


def rank_list(df: DataFrame, share: float = 0.05) -> DataFrame:
    """student_no, student, programme, cgpa, clean_rank, n, quota, in_top, is_first, serial inside the programme."""
    rows = with_key(bind(df, WANTED, required=("Student No", "Program Name", "Rank")), "Student No", "Program Name")
    out = rows.select(
        F.col("Student No").alias("student_no"), F.col("Student Name").alias("student"), F.col("Program Name").alias("programme"), number(F.col("CGPA")).alias("cgpa"), first_number(F.col("Rank")).alias("clean_rank")
    )
    sizes = out.groupBy("programme").agg(F.count("*").alias("n"))
    out = out.join(sizes, "programme").withColumn("quota", quota(F.col("n"), share))
    serial = F.row_number().over(Window.partitionBy("programme").orderBy(F.asc_nulls_last("clean_rank"), "student_no"))
    return out.withColumns({"in_top": F.col("clean_rank") <= F.col("quota"), "is_first": F.coalesce(F.col("clean_rank") == 1, F.lit(False)), "serial": serial})
