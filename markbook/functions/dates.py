"""Column expressions over dates, times and durations. "Today" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markbook.functions.numbers import number
from markbook.functions.text import strip, text

DAY_FIRST = "d/M/yyyy"
#: Formats in which holidays are given.
HOLIDAY_FORMATS = ("d/M/yyyy", "yyyy-M-d", "d-M-yyyy")


def parsed(c: Column, *formats: str) -> Column:
    """The date a text holds under the first format that fits, else null."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(strip(c), F.lit(f))) for f in formats or (DAY_FIRST,)))


def shown(d: Column) -> Column:
    """Day-first text, ``-`` for null."""
    return F.coalesce(F.date_format(d, "dd/MM/yyyy"), F.lit("-"))


def window_days(start: Column, end: Column) -> Column:
    """Days from start to end, null if negative."""
    n = F.datediff(end, start)
    return F.when(n >= 0, n)


def deadline_state(pending: Column, deadline: Column, as_of: Column) -> Column:
    """D3: overdue, today, tomorrow or none for rows with something pending."""
    days = F.datediff(deadline, as_of)
    return F.when(~F.coalesce(pending > 0, F.lit(False)) | days.isNull(), "none").when(days < 0, "overdue").when(days == 0, "today").when(days == 1, "tomorrow").otherwise("none")


def seconds(c: Column) -> Column:
    """Seconds of ``HH:MM[:SS]`` (seconds ignored) or of a number of hours (truncated); 0 if neither."""
    s = strip(c)
    parts = F.split(s, ":")
    clock = F.try_element_at(parts, F.lit(1)).try_cast("int") * 3600 + F.try_element_at(parts, F.lit(2)).try_cast("int") * 60
    return F.coalesce(F.when(s.contains(":"), clock).otherwise(F.floor(number(s)) * 3600), F.lit(0)).cast("int")


def duration_text(secs: Column) -> Column:
    """``HH:MM:00``."""
    return F.format_string("%02d:%02d:00", F.floor(secs / 3600).cast("int"), F.floor(secs % 3600 / 60).cast("int"))


def minutes_of_day(c: Column) -> Column:
    """Minutes since midnight of ``hh:mm AM``."""
    t = F.try_to_timestamp(strip(c), F.lit("hh:mm a"))
    return F.hour(t) * 60 + F.minute(t)


def clock(minutes: Column) -> Column:
    m = F.pmod(minutes, F.lit(1440)).cast("int")
    h = F.floor(m / 60).cast("int")
    twelve = F.when(h % 12 == 0, 12).otherwise(h % 12)
    return F.format_string("%02d:%02d %s", twelve.cast("int"), (m % 60).cast("int"), F.when(h < 12, "AM").otherwise("PM"))


def time_range(start: Column, secs: Column) -> Column:
    """``10:00 AM - 12:00 PM``."""
    m = minutes_of_day(start)
    return F.concat(clock(m), F.lit(" - "), clock(m + F.floor(secs / 60)))


def timetable_time(c: Column) -> Column:
    """``10:00 am to 12:00 noon``."""
    s = F.lower(F.replace(text(c), F.lit(" - "), F.lit(" to ")))
    return F.replace(s, F.lit("12:00 pm"), F.lit("12:00 noon"))


def working_days(spark: SparkSession, start: str, n: int, holidays: DataFrame | None = None) -> DataFrame:
    """(slot, day): the first ``n`` days from ``start`` that are no Sunday and no holiday (column ``day``)."""
    free = 0 if holidays is None else holidays.select("day").distinct().count()
    span = n + n // 6 + free + 8
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.date_add(F.lit(start).cast("date"), span))).alias("day")).where(F.weekday("day") != 6)
    if holidays is not None:
        days = days.join(holidays.select("day").distinct(), "day", "left_anti")
    return days.select(F.row_number().over(Window.orderBy("day")).alias("slot"), "day").where(F.col("slot") <= n)


def time_options(spark: SparkSession, first: str = "07:00", last: str = "15:00", step: int = 30) -> DataFrame:
    """Clock texts every ``step`` minutes."""
    at = lambda t: int(t[:2]) * 60 + int(t[3:])
    return spark.range(at(first), at(last) + 1, step).select(clock(F.col("id")).alias("option"))


def long_date(d: Column) -> Column:
    """``Saturday, January 10, 2026``."""
    return F.date_format(d, "EEEE, MMMM d, yyyy")
