"""Figures of student master data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.functions.numbers import percent
from markbook.operators.aggregates import frequency
from markbook.operators.schema import bind
from markbook.operators.windows import distinct_rank, latest

WANTED = {
    "student": ("Student Number", "Student ID", "PRN"), "programme": ("Program Name",), "session": ("Academic Sess", "Academic Session", "Semester", "Sem"), "gender": ("Gender",), "division": ("Div",),
    "status": ("Final Status",), "religion": ("Religion",), "class": ("Social Class", "Caste"), "organisation": ("Org. Name",), "domicile": ("Domicile",), "nationality": ("Nationality",), "disability": ("Disability",),
}


def student_master(df: DataFrame) -> dict[str, DataFrame]:
    """Frames by name: students (latest row each), kpi, by_session, by_session_programme, by_gender, and one per demographic."""
    rows = bind(df, WANTED, required=("student",), on_duplicate="last").where("student is not null")
    students = latest(rows, "student", [F.desc_nulls_last("session"), F.asc_nulls_last("programme"), F.asc_nulls_last("status")])
    labelled = distinct_rank(rows, "session", "n").withColumn("semester", F.concat(F.lit("Semester "), F.col("n")))
    passed = F.count_if(F.lower(F.trim("status")).startswith("pass"))
    kpi = students.agg(F.count("*").alias("students"), F.countDistinct("programme").alias("programmes"), passed.alias("passed")).withColumn("pass_pct", percent(F.col("passed"), F.col("students")))
    out = {
        "students": students,
        "kpi": kpi,
        "by_session": labelled.where("semester is not null").groupBy("semester").agg(F.countDistinct("student").alias("students")),
        "by_session_programme": labelled.where("semester is not null").groupBy("semester", "programme").agg(F.countDistinct("student").alias("students")),
        "by_gender": students.groupBy("programme", "gender").agg(F.count("*").alias("n")),
    }
    return out | {c: frequency(students, c) for c in ("programme", "gender", "division", "status", "religion", "class", "organisation", "domicile", "nationality", "disability")}


def worth_showing(table: DataFrame) -> bool:
    """F32: a demographic with more than one value."""
    return table.limit(2).count() > 1
