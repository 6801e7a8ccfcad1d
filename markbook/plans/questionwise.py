"""Question-wise check of marks by examiners and reviewers. Input columns as the exports have them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markbook.functions.numbers import change_percent, direction, grade, number, total_obtained
from markbook.functions.text import score_label, strip
from markbook.operators.aggregates import change_counts, rule_of_share
from markbook.operators.filters import drop_empty, drop_matching, in_group_any, numeric_key, of_entities, with_key
from markbook.operators.joins import against_baseline, lookup
from markbook.operators.schema import header_maximum, metric_columns

# The columns that are no questions, and the order of reviewers.
FIXED = (
    "SrNo", "ExamAssingment_ID", "Subject Name-Subject code", "OnScreenID", "SubjectName", "Semester", "RollNo", "PRNNumber", "Name", "CampusName", "UserType", "MarkAttendance", "Email",
    "Semester Total Max Marks", "Semester Marks", "Internal Marks", "Total Max Marks", "Total Marks Obtained", "Grade", "Change %", "TotalObtainedScore", "_row_no",
)
REVIEWERS = {"Examiner": 1, "Moderator": 2, "Reval 1": 3, "Reval 2": 4}
KEY, SUBJECT, ROW = "PRNNumber", "Subject Name-Subject code", "_row_no"


def is_kind(kind: str):
    return F.lower(strip(F.col("UserType"))) == kind.lower()


def reviewer_order():
    out = None
    for name, n in REVIEWERS.items():
        out = F.when(is_kind(name), n) if out is None else out.when(is_kind(name), n)
    return out.otherwise(99)


def clean(df: DataFrame) -> DataFrame:
    """F1, F4-F6, T4; the key stays text."""
    rows = numeric_key(with_key(drop_matching(drop_empty(df), columns=["SrNo"] if "SrNo" in df.columns else df.columns[:1]), KEY), KEY)
    return rows.withColumn(KEY, strip(F.regexp_replace(F.col(KEY), r"\.0$", ""))).withColumn("reviewer", reviewer_order()).orderBy(KEY, "reviewer", ROW)


def with_register(df: DataFrame, register: DataFrame) -> DataFrame:
    """Marks of the grade register by (student, module), last row of equal keys; total and grade."""
    side = register.select(strip(F.col("Student Number")).alias(KEY), strip(F.col("Modulecode")).alias("code"), F.col("AGR type").alias("kind"), F.col("Grades").alias("mark"), F.col("MAX Marks").alias("largest"), ROW)
    out = df.withColumn("code", F.trim(F.element_at(F.split(F.col(SUBJECT), "-"), -1)))
    for prefix, column, name in (("Internal Total", "mark", "Internal Marks"), ("Composite ", "largest", "Total Max Marks"), ("Semester Total", "largest", "Semester Total Max Marks"), ("Semester Total Marks", "mark", "Semester Marks")):
        out = lookup(out, side.where(F.col("kind").startswith(prefix)), [KEY, "code"], {column: name}, [ROW], "last", "")
    moderated = F.max(F.when(is_kind("Moderator"), 1).otherwise(0)).over(Window.partitionBy(KEY, SUBJECT)) == 1
    keeps = is_kind("Moderator") | (is_kind("Examiner") & ~moderated)
    out = out.withColumn("Semester Marks", F.when(keeps, F.col("Semester Marks")).otherwise(""))
    out = out.withColumn("Total Marks Obtained", total_obtained(F.col("TotalObtainedScore"), F.col("Internal Marks")))
    return out.withColumn("Grade", grade(F.col("Total Marks Obtained"), number(F.col("Total Max Marks")))).drop("code")


def with_change(df: DataFrame, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """``Change %`` on the first moderator row of a student."""
    paper = F.lit(header_maximum(metric_columns(df.columns, FIXED)))
    rows = against_baseline(df.withColumn("__score", number(F.col("TotalObtainedScore"))), list(keys), is_kind("Examiner"), "__score", [ROW])
    first = F.row_number().over(Window.partitionBy(*keys, F.lower(strip(F.col("UserType")))).orderBy(ROW)) == 1
    have = lambda c: number(F.col(f"`{c}`")) if c in df.columns else F.lit(None).cast("double")
    pct = change_percent(F.col("baseline"), F.col("__score"), have("Semester Total Max Marks"), have("Total Max Marks"), paper)
    return rows.withColumn("Change %", F.when(is_kind("Moderator") & first, pct)).drop("baseline", "__score")


def change_summary(df: DataFrame, kind: str = "Moderator") -> DataFrame:
    """A17."""
    rows = against_baseline(df.withColumn("score", number(F.col("TotalObtainedScore"))), [KEY], is_kind("Examiner"), "score", [ROW])
    return change_counts(rows.where(is_kind(kind)), [], F.col("baseline"), F.col("score"))


def ten_percent_rule(df: DataFrame) -> DataFrame:
    """A18."""
    return rule_of_share(df.where(is_kind("Moderator")), [], F.abs(F.col("Change %")) > 10)


def reviewed(df: DataFrame) -> DataFrame:
    """F25."""
    return of_entities(df, KEY, ~is_kind("Examiner"))


def changed(df: DataFrame) -> DataFrame:
    """students with any reviewer score that differs from the examiner's."""
    rows = against_baseline(df.withColumn("score", number(F.col("TotalObtainedScore"))), [KEY], is_kind("Examiner"), "score", [ROW])
    return of_entities(rows, KEY, ~is_kind("Examiner") & (F.col("score") != F.col("baseline"))).drop("score", "baseline")


def for_download(df: DataFrame, every_reviewer: bool = False) -> DataFrame:
    """Moderated students by their moderator rows only, score labels, without revaluations."""
    rows = df if every_reviewer else in_group_any(df.where(~F.lower(strip(F.col("UserType"))).isin("reval 1", "reval 2")), [KEY], is_kind("Moderator"), is_kind("Moderator"))
    return rows.withColumn("TotalObtainedScore", score_label(F.col("TotalObtainedScore"), F.col("MarkAttendance")))


def question_changes(df: DataFrame) -> DataFrame:
    """(student, reviewer, question, examiner mark, mark, direction) in long form."""
    questions = [c for c in metric_columns(df.columns, FIXED) if c != "reviewer"]
    rows = df.select(KEY, "UserType", ROW, *(number(F.col(f"`{q}`")).alias(q) for q in questions)).unpivot([KEY, "UserType", ROW], questions, "question", "mark")
    rows = against_baseline(rows, [KEY, "question"], is_kind("Examiner"), "mark", [ROW])
    return rows.where(~is_kind("Examiner")).select(KEY, "UserType", "question", F.col("baseline").alias("examiner"), "mark", direction(F.col("mark"), F.col("baseline")).alias("direction"))
