"""Examination timetable: papers that share a student get different days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.functions.dates import duration_text, seconds, time_range
from markbook.functions.text import canonical_subject, clean_cell, first_year, strip
from markbook.operators.aggregates import common_groups
from markbook.operators.filters import with_key
from markbook.operators.graph import assign_slots, cluster_names, conflict_graph
from markbook.operators.joins import flagged_lookup
from markbook.operators.reshape import crosstab_sum, crosstab_text
from markbook.operators.schema import bind
from markbook.sources.sheetwriter import Sheet, write_workbooks

WANTED = {
    "school": ("School Name",), "programme": ("Program Name",), "abbreviation": ("Program Abbreviation",), "year": ("Current Academic Year",), "session": ("Current Session",), "subject": ("Module Description",),
    "module": ("Module Abbreviation",), "credit": ("Credit",), "student": ("Student Number",), "duration": ("Exam Duration",), "mode": ("Student NA",),
}
APPLICATION = {"programme": ("Prog. Name",), "abbreviation": ("Prog. Code",), "module": ("Module code",), "subject": ("Module name",), "student": ("Student number",), "year": ("Acad. Year",), "session": ("Acad. Session",), "gr": ("GR Applicable",), "appraisal": ("Appraisal Description",)}
REPORT = {"school": ("School Name",), "abbreviation": ("Program Abbreviation",), "year": ("Current Academic Year",), "session": ("Current Session",), "module": ("Module Abbreviation",), "credit": ("Credit",), "gr": ("Is GR Applicable?",), "mode": ("Exam Mode",), "duration": ("Exam Duration",)}


def reexam(applications: DataFrame, report: DataFrame) -> DataFrame:
    """Applications with the report's fields, first row of equal keys; ``incomplete`` where it has none."""
    said = lambda c, v: F.upper(strip(F.col(c))) == v
    app = bind(applications, {**APPLICATION, "_row_no": ()}, fold="words", prefix=True).where(said("gr", "YES") & said("appraisal", "SEM ACTUAL"))
    rep = bind(report, {**REPORT, "_row_no": ()}, fold="words", prefix=True).where(said("mode", "WRIT") & said("gr", "Y"))
    keys = ["abbreviation", "module", "session", "year"]
    tidy = lambda df: df.withColumn("year", first_year(clean_cell(F.col("year")))).withColumns({k: F.upper(strip(F.col(k))) for k in keys})
    side = tidy(rep).select(*keys, "school", "credit", "duration", F.col("_row_no").cast("int").alias("_row_no"))
    return flagged_lookup(tidy(app).drop("_row_no", "gr", "appraisal"), side, keys, {"school": "school", "credit": "credit", "duration": "duration"}, ["_row_no"])


def nodes(df: DataFrame, threshold: float = 1.0, manual: DataFrame | None = None) -> DataFrame:
    """Enrolments with ``canon`` and ``node`` (canonical subject, session, duration)."""
    rows = df if "subject" in df.columns else bind(df, WANTED, required=("school", "programme", "year", "session", "subject", "student", "duration"), fold="nospace")
    if "mode" in rows.columns:
        rows = rows.where(F.col("mode").isNull() | (strip(F.col("mode")) == "") | (F.upper(strip(F.col("mode"))) == "WRIT"))
    rows = with_key(rows, "subject", "student").withColumn("plain", canonical_subject(F.col("subject")))
    if threshold < 1:
        rows = rows.join(cluster_names(rows, "plain", "student", threshold).withColumnRenamed("name", "plain"), "plain", "left")
    else:  # every name is its own cluster
        rows = rows.withColumn("cluster", F.col("plain"))
    if manual is not None:
        rows = rows.join(manual.select(canonical_subject(F.col("description")).alias("plain"), F.col("group").alias("manual")).dropDuplicates(["plain"]), "plain", "left")
    else:
        rows = rows.withColumn("manual", F.lit(None).cast("string"))
    rows = rows.withColumn("canon", F.coalesce("manual", "cluster", "plain"))
    return rows.withColumn("node", F.concat_ws(" | ", "canon", F.coalesce("session", F.lit("")), F.coalesce("duration", F.lit(""))))


def schedule(df: DataFrame, days: DataFrame, start: str, reexam: bool = False, threshold: float = 1.0, manual: DataFrame | None = None) -> DataFrame:
    """One row a paper with its day and time; ``days``: (slot, day). Years of a re-examination are merged."""
    enrolled = nodes(df, threshold, manual)
    vertices, edges = conflict_graph(enrolled, "student", "node")
    slots = assign_slots(vertices, edges)
    keys = ["node", "canon", "school", "abbreviation", "programme", "module", "subject", "credit", "duration", "session"]
    keys = [k for k in keys if k in enrolled.columns and not (reexam and k == "programme")]
    papers = enrolled.groupBy(*keys, *([] if reexam else ["year"])).agg(F.countDistinct("student").alias("students"), *([F.array_join(F.array_sort(F.collect_set("year")), ", ").alias("year")] if reexam else []))
    common = common_groups(enrolled, "canon", "subject", "programme").select("canon", "is_common")
    dated = papers.join(slots, "node").join(days, "slot", "left").join(common, "canon")
    secs = seconds(F.col("duration"))
    return dated.withColumns({"duration_shown": duration_text(secs), "secs": secs, "time": time_range(F.lit(start), secs)}).orderBy("day", F.desc("secs"), "school", "subject")


def timetable_grid(scheduled: DataFrame, columns: list[str], column: str = "school") -> DataFrame:
    """Modules by (day, time) and ``column``."""
    item = F.concat(F.col("subject"), F.lit(" ("), F.col("year"), F.lit(" | "), F.col("students"), F.lit(")"))
    return crosstab_text(scheduled, ["day", "time"], column, columns, item, [-F.col("secs"), F.col("subject")]).orderBy("day", "time")


def analysis_grid(scheduled: DataFrame, columns: list[str], column: str = "school") -> DataFrame:
    """Students by (day, time) and ``column`` with totals."""
    return crosstab_sum(scheduled, ["day", "time"], column, columns, "students").orderBy("day", "time")


def discovered(df: DataFrame, column: str, most: int = 512) -> list:
    """The sorted distinct values of a column that become columns; more than ``most`` are refused."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return found


def grids(scheduled: DataFrame, keys: Sequence[str] = ("school", "session")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Schedule, timetable and analysis of papers with day, time, secs, subject, year, students.

    Columns are found first: one for each (school, session), ordered. Rows stand in order of day and time; in a cell the longest
    paper comes first.
    """
    placed = scheduled.withColumn("column", F.concat_ws(" / ", *keys))
    columns = discovered(placed, "column")
    order = ["day", F.desc("secs"), "time", *keys, "subject"]
    return placed.drop("column").orderBy(*order), timetable_grid(placed, columns, "column"), analysis_grid(placed, columns, "column")


def timetable_workbook(folder: str, scheduled: DataFrame, incomplete: DataFrame | None = None, name: str = "Timetable") -> DataFrame:
    """K7: schedule, timetable, analysis and, where there is one, the incomplete data, as sheets of one workbook."""
    schedule, timetable, analysis = grids(scheduled)
    sheets = {"Schedule": Sheet(schedule.withColumn("__less", -F.col("secs")), ["day", "__less", "time", "school", "session", "subject"], ["secs", "__less"], continues=True), "Timetable": Sheet(timetable, ["day", "time"]), "Analysis": Sheet(analysis, ["day", "time"])}
    if incomplete is not None:
        sheets["Incomplete Data"] = Sheet(incomplete, incomplete.columns[:1], continues=True)
    return write_workbooks(folder, sheets, name=name)


def working_days(spark: SparkSession, start: str, n: int, holidays: DataFrame | None = None) -> DataFrame:
    from markbook.functions.dates import working_days as days

    return days(spark, start, n, holidays)
