"""Convocation list from result reports and a student master."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.functions import text as X
from markbook.operators.aggregates import with_total
from markbook.operators.filters import gpa_complete
from markbook.operators.joins import lookup, unmatched
from markbook.operators.schema import bind, conform

# Fixed value: the columns of the list, in order.
TARGET = (
    "LOTNO CONVID FACULTY PRNERN APAAR_ID PROGTYPE APPL_NO SEAT_NO COLL_NO COLL_NAME COLL_NAMEM STUDLASTNAME STUDFIRSTNAME STUDMIDDDLENAME STUDMOTHERNAME NAME NAME_MARAT SEX ABBR CLASS CGPA MCLASS "
    "SUB1 SUB1_NAME SUB1_NAMEM SUB2 SUB2_NAME SUB2_NAMEM DEGNM MDEGNM SUBDEGNM MSUBDEGNM MONTH MMONTH CGPA_Source_File"
).replace("APAAR_ID", "APAAR,ID").replace("CGPA_Source_File", "CGPA,Source,File").split()
TARGET = [c.replace(",", " ") for c in TARGET]
RESULT = {"student": ("Student Number",), "name": ("Student Name",), "gender": ("Gender",), "grade": ("Final Grade",), "cgpa": ("CGPA",), "month": ("Highest month of passing",), "convocation": ("Convocation Number",), "entry": ("Student RE",), "prn": ("PRN",)}


def master_lookup(master: DataFrame) -> DataFrame:
    """(key, programme, apaar, _row_no) of the master rows that name a programme."""
    rows = bind(master, {"student": ("Student Number",), "programme": ("Program Name", "Programme Name", "Degree Name"), "apaar": ("ABC ID", "APAAR ID"), "_row_no": ()}, required=("student",), fold="words")
    return rows.where(~X.blank(F.col("programme"))).select(X.clean_key(F.col("student")).alias("key"), "programme", "apaar", "_row_no")


def eligible(report: DataFrame, master: DataFrame) -> DataFrame:
    """Rows with a CGPA, without a convocation number, with all averages they must have."""
    gpas = {n: F.col(f"`{c}`") for n in range(1, 7) if (c := next((x for x in report.columns if x.strip().lower() == f"sem {n}_gpa"), None))}
    rows = bind(report.select("*", *(g.alias(f"__gpa{n}") for n, g in gpas.items())), {**RESULT, **{f"__gpa{n}": () for n in gpas}}, required=("student",), fold="words")
    if not any(c.strip().lower() == "cgpa" for c in report.columns):
        rows = rows.limit(0)
    rows = rows.where(~X.blank(F.col("cgpa")) & X.blank(F.col("convocation"))).withColumn("key", X.clean_key(F.col("student")))
    found = lookup(rows, master_lookup(master), ["key"], {"programme": "programme", "apaar": "apaar"}, ["_row_no"], "last", "")
    return found.where(gpa_complete(F.col("programme"), F.col("entry"), {n: F.col(f"__gpa{n}") for n in gpas}))


def convocation(report: DataFrame, master: DataFrame, college: dict[str, str], source: str = "") -> DataFrame:
    """The list; ``college``: COLL_NO, COLL_NAME, COLL_NAMEM."""
    rows = eligible(report, master)
    made = {
        "FACULTY": X.faculty(F.col("programme")), "PRNERN": F.col("prn"), "APAAR ID": F.col("apaar"), "SEAT_NO": F.col("key"), "NAME": F.col("name"), "NAME_MARAT": X.transliterate(F.col("name")), "SEX": X.gender_code(F.col("gender")),
        "CLASS": X.class_text(F.col("grade")), "CGPA": F.col("cgpa"), "DEGNM": F.col("programme"), "SUBDEGNM": X.course_length(F.col("programme")), "MONTH": X.month_text(F.col("month")), "MMONTH": X.devanagari_digits(X.month_text(F.col("month"))),
        "CGPA Source File": F.lit(source), **{k: F.lit(v) for k, v in college.items()},
    }
    return conform(rows.select(*(v.cast("string").alias(k) for k, v in made.items())).distinct(), TARGET).orderBy("SEAT_NO")


def exceptions(report: DataFrame, master: DataFrame) -> DataFrame:
    """Students the master doesn't know."""
    rows = bind(report, RESULT, required=("student",), fold="words").withColumn("key", X.clean_key(F.col("student")))
    return unmatched(rows, master_lookup(master), ["key"], ["student", "name"])


def statistics(listed: DataFrame) -> DataFrame:
    """A8."""
    return with_total(listed, "DEGNM", {"male": F.count_if(F.col("SEX") == "1"), "female": F.count_if(F.col("SEX") == "2"), "total": F.count("*")}, missing="[UNMATCHED PROGRAM]")
