"""On-screen marking dashboard. Input columns as the exports have them, all text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.functions.dates import deadline_state, parsed, shown, window_days
from markbook.functions.numbers import count_of, percent
from markbook.functions.text import abbreviation, before_marker, exam_type, extended
from markbook.operators.aggregates import frequency, sums
from markbook.operators.filters import choose, dates_within, drop_empty, drop_matching, overdue, search

COUNTS = ("AbsentCount", "PresentCount", "CheckCount", "InprogressCount", "RejectCount", "UnCheckCount", "UploadCount")
DATES = {"ExamDate": "exam_date", "AssignedDateTime": "assigned", "EvaluationLastDate": "deadline"}
MARKER = "Evaluation Dashboard Details"


def load(frames: Mapping[str, DataFrame], known: list[tuple[str, str]] | None = None) -> DataFrame:
    """Typed rows of all exports, by file name; ``known``: (short name, keyword pattern) of institutions."""
    out = None
    for name, df in frames.items():
        df = drop_matching(drop_empty(df)).withColumn("Source_File", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    out = out.withColumnsRenamed({"Semester/Trimester": "Semester"})
    have = set(out.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    out = out.withColumns({c: count_of(text(c)) for c in COUNTS} | {new: parsed(text(c)) for c, new in DATES.items()})
    out = out.withColumn("College_Full", before_marker(F.col("Source_File"), MARKER, "Institute"))
    return out.withColumns(
        {"College": abbreviation(F.col("College_Full"), known or []), "Exam_Type": exam_type(text("CategoryName")), "window_days": window_days(F.col("assigned"), F.col("deadline")), "Extended": extended(text("OldEvaluationLastDate")), "deadline_shown": shown(F.col("deadline"))}
    )


def filtered(df: DataFrame, choices: Mapping[str, object] | None = None, dates: tuple | None = None, drop_undated: bool = True) -> DataFrame:
    """F7, F9. Rows without an exam date fall out of a date filter unless ``drop_undated`` is off."""
    df = choose(df, choices or {})
    return df if dates is None else dates_within(df, "exam_date", *dates, drop_undated=drop_undated)


def kpis(df: DataFrame, as_of: str) -> DataFrame:
    """One row."""
    late = F.when((F.col("UnCheckCount") > 0) & (F.col("deadline") < F.lit(as_of).cast("date")), 1).otherwise(0)
    out = sums(df, [], {c: F.col(c) for c in COUNTS} | {"overdue": late})
    return out.withColumns({"progress_pct": percent(F.col("CheckCount"), F.col("PresentCount")), "attendance_pct": percent(F.col("PresentCount"), F.col("PresentCount") + F.col("AbsentCount")), "has_rejections": F.col("RejectCount") > 0})


def by(df: DataFrame, keys: list[str], top: int | None = None, measure: str = "PresentCount", drop_null_keys: bool = True) -> DataFrame:
    """Counts and completion by keys; the ``top`` largest if asked for."""
    out = sums(df, keys, {c: F.col(c) for c in COUNTS}, drop_null_keys).withColumn("completion_pct", percent(F.col("CheckCount"), F.col("PresentCount")))
    out = out.orderBy(F.desc(measure), *keys)
    return out if top is None else out.limit(top)


def pending(df: DataFrame, as_of: str) -> DataFrame:
    """F11, T3, D3."""
    state = deadline_state(F.col("UnCheckCount"), F.col("deadline"), F.lit(as_of).cast("date"))
    return df.where("UnCheckCount > 0").withColumn("state", state).orderBy(F.asc_nulls_last("deadline"))


def rejected(df: DataFrame) -> DataFrame:
    return df.where("RejectCount > 0").orderBy(F.desc("RejectCount"))


def completed(df: DataFrame, query: str | None = None) -> DataFrame:
    done = df.where("UnCheckCount = 0")
    return search(done, query) if query else done


def late_rows(df: DataFrame, as_of: str) -> DataFrame:
    return overdue(df, "UnCheckCount", "deadline", as_of)


def deadline_profile(df: DataFrame) -> dict[str, DataFrame]:
    """Frequencies of the window lengths and of extensions."""
    return {"window_days": frequency(df.withColumn("window_days", F.col("window_days").cast("string")), "window_days"), "extended": frequency(df, "Extended")}
