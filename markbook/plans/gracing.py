"""Gracing sheets: restructured students, graced cases and summaries. Input columns as the sheets have them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.functions.numbers import failed, mark, mismatch, number, number_or_zero, scale_max
from markbook.functions.text import joined, strip, text
from markbook.operators.aggregates import listed, summary
from markbook.operators.joins import first_of_kinds, siblings
from markbook.session import written

# Appraisal types and the status of a failed student (as the sheets spell it).
INTERNAL, ACTUAL, GRACE, TOTAL_GRACE, SEMESTER, COMPOSITE, GRADE = "Internal Actual", "Sem Actual", "Sem Grace", "Grace on Total marks", "Semester Total Marks", "Composite Score", "Overall Grade"
FAILED = "completed unsuccessfuly"
TYPE, BEFORE, AFTER = "Appraisal Type Code", "Marks before Gracing", "Marks after Gracing"
ROW = "_row_no"


def modules(df: DataFrame) -> DataFrame:
    """rows of modules; summary rows and blank ones go."""
    name = text(F.col("Student Name"))
    sums = (F.upper(name).contains("TOTAL") | F.upper(name).contains("PERCENTAGE")) & F.upper(strip(name)).isin("TOTAL", "PERCENTAGE")  # few names are stripped
    return df.where(text(F.col("Module Desc")).rlike(r"(?U)\S") & ~sums)


def failed_students(df: DataFrame) -> DataFrame:
    """F20."""
    status = F.col("Completion Status after Gracing")
    return df.where(F.lower(status).contains(FAILED) & (F.lower(strip(status)) == FAILED)).select("Student Number").where("`Student Number` is not null").distinct()


def graced(df: DataFrame) -> DataFrame:
    """rows that got grace marks, as ``grace``."""
    return modules(df).withColumn("grace", number_or_zero(F.col(AFTER))).where(F.col(TYPE).isin(GRACE, TOTAL_GRACE) & (F.col("grace") > 0))


def graced_cases(df: DataFrame) -> DataFrame:
    """Graced rows with the student's other marks of the module."""
    keys, kinds = ["Student Number", "Module Code"], {ACTUAL: "actual", SEMESTER: "semester", COMPOSITE: "composite", GRADE: "grade"}
    cases = graced(df).select(*keys, "Student Name", "Module Desc", "grace", ROW)
    # Only marks of graced modules are sorted and combined, after one shuffle without a sort.
    marks = modules(df).where(F.col(TYPE).isin(*kinds)).select(*keys, TYPE, AFTER, ROW).join(cases.select(*keys).distinct().hint("shuffle_hash"), keys, "left_semi")
    return cases.join(siblings(marks, keys, TYPE, AFTER, kinds, [ROW]), keys, "left")


def subject_summary(cases: DataFrame) -> DataFrame:
    return summary(cases, ["Module Code", "Module Desc"], "Student Number", "grace")


def student_summary(cases: DataFrame) -> DataFrame:
    item = F.concat(F.col("Module Desc"), F.lit(" (+"), F.format_string("%s", F.col("grace").cast("int")), F.lit(")"))
    total = cases.groupBy("Student Number").agg(F.sum("grace").alias("total"))
    return listed(cases, ["Student Number"], item, [ROW]).join(total, "Student Number")


def processed(df: DataFrame, students: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """HEADER, DATA (one a module) and SUMMARY rows of every student, with flags; if ``ordered``, by (student, kind, seq)."""
    rows = df if students is None else df.join(students.select("Student Number").distinct().hint("shuffle_hash"), "Student Number", "left_semi")
    own = modules(rows)
    keys = ["Student Number", "Module Code", "Module Desc"]
    kinds = {INTERNAL: "internal", ACTUAL: "actual", GRACE: "grace", TOTAL_GRACE: "total_grace", COMPOSITE: "composite", GRADE: "grade"}
    cells = first_of_kinds(TYPE, F.struct(F.col(AFTER).alias("after"), F.col("Scale").alias("scale")), kinds, [ROW])
    first = {"Credit": "credit", "General Remarks": "remarks", "Student Name": "name", "Additional ID": "other", "Gender": "gender", "Completion Status after Gracing": "status"}
    rest = F.min_by(F.struct(*(F.col(f"`{k}`").alias(v) for k, v in first.items())), ROW).alias("rest")
    wide = own.groupBy(*keys).agg(*cells, F.min(ROW).alias("seq"), rest)  # all of a module, and of its student, in one shuffle
    data = wide.select(*keys, F.col("seq").cast("long").alias("seq"), "rest", *(F.col(f"{v}.after").alias(v) for v in kinds.values()), *(F.col(f"{v}.scale").alias(f"{v}_scale") for v in kinds.values()))
    for k in ("internal", "actual", "grace", "total_grace", "composite"):
        data = data.withColumns({f"m_{k}": mark(F.col(k)), f"max_{k}": scale_max(F.col(f"{k}_scale"))})
    bonus = F.coalesce(F.col("m_grace.value"), F.col("m_total_grace.value"))
    data = data.select(
        "Student Number", F.lit("DATA").alias("kind"), "seq", F.concat_ws(" - ", "Module Code", "Module Desc").alias("label"), number(F.col("rest.credit")).alias("credit"),
        F.col("m_internal.display").alias("internal"), F.col("m_actual.display").alias("actual"), bonus.alias("grace"), F.col("m_composite.display").alias("composite"), "grade", "rest.remarks",
        failed(F.col("m_internal.value"), F.col("max_internal"), F.col("m_internal.special")).alias("red_internal"), failed(F.col("m_actual.value"), F.col("max_actual"), F.col("m_actual.special")).alias("red_sem"),
        (F.coalesce(bonus, F.lit(0.0)) > 0).alias("red_grace"),
        mismatch([F.col("m_internal.value"), F.col("m_actual.value"), bonus], F.col("m_composite.value")).alias("red_composite"), F.col("m_composite.value").alias("points"),
        "rest", (F.col("Student Number").isNotNull() & F.col("Module Code").isNotNull() & F.col("Module Desc").isNotNull()).alias("whole"),
    )
    made = written(data, "gracing")
    data = made.where("whole").drop("rest", "whole")
    who = made.groupBy("Student Number").agg(F.min_by("rest", "seq").alias("w"))
    blank = lambda kind, label, **kw: {**{c: F.lit(None).cast(t) for c, t in data.dtypes}, "Student Number": F.col("Student Number"), "kind": F.lit(kind), "seq": F.lit(0).cast("long"), "label": label, **kw}
    head = who.select(*(v.alias(k) for k, v in blank("HEADER", joined([F.col("Student Number"), F.col("w.name"), F.col("w.other"), F.col("w.gender")])).items()))
    sums = data.groupBy("Student Number").agg(F.sum("credit").alias("c"), F.sum("points").alias("p")).join(who, "Student Number")
    tail = sums.select(*(v.alias(k) for k, v in blank("SUMMARY", text(F.col("w.status")), credit=F.col("c"), points=F.col("p")).items()))
    out = head.unionByName(data).unionByName(tail)
    order = F.when(F.col("kind") == "HEADER", 0).when(F.col("kind") == "DATA", 1).otherwise(2)
    return out.orderBy("Student Number", order, "seq") if ordered else out
