"""The record behind an examiner's letter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.functions.text import strip
from markbook.operators.windows import ranked

FIELDS = {"ExaminerName": "name", "ExaminerEmail": "email", "Mobile": "mobile", "CourseName": "course", "StreamName": "stream", "Semester/Trimester": "semester", "ExamDate": "exam_date", "CampusName": "campus"}


def letter_records(df: DataFrame, role: str, year: str, academic_year: str, default: str = "-") -> DataFrame:
    """the assignments of a role, numbered by examiner; blanks as ``default``. The years are parameters."""
    rows = df.where(F.lower(strip(F.col("RoleName"))) == role.lower())
    have = {c: n for c, n in FIELDS.items() if c in df.columns}
    named = rows.select(*(F.coalesce(F.nullif(strip(F.col(f"`{c}`")), F.lit("")), F.lit(default)).alias(n) for c, n in have.items()), "_row_no")
    return ranked(named, ["name"], [F.asc("_row_no")], "assignment").withColumns({"year": F.lit(year), "academic_year": F.lit(academic_year)})
