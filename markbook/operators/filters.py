"""Row filters. Predicates treat null as false."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markbook.functions.numbers import number
from markbook.functions.text import blank, strip, text


def holds(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def drop_empty(df: DataFrame) -> DataFrame:
    """without rows that are null or blank in every column."""
    return df.where(~F.forall(F.array(*(text(F.col(f"`{c}`")) for c in df.columns)), lambda x: F.trim(x) == ""))


def drop_matching(df: DataFrame, pattern: str = r"(?i)Count\s*:", columns: Sequence[str] | None = None) -> DataFrame:
    """without rows where any of the columns matches."""
    return df.where(~F.exists(F.array(*(text(F.col(f"`{c}`")) for c in columns or df.columns)), lambda x: x.rlike(pattern)))


def with_key(df: DataFrame, *keys: str) -> DataFrame:
    """rows whose keys aren't blank."""
    for k in keys:
        df = df.where(~blank(F.col(k)))
    return df


def numeric_key(df: DataFrame, key: str) -> DataFrame:
    """rows whose key is a number; the key stays text."""
    return df.where(number(F.col(key)).isNotNull())


def choose(df: DataFrame, choices: Mapping[str, object], everything: str = "All") -> DataFrame:
    """equality filters; a choice of ``everything`` or None filters nothing."""
    for c, v in choices.items():
        if v is not None and v != everything:
            df = df.where(F.col(c) == F.lit(v))
    return df


def year_is(c: Column, year: str) -> Column:
    """F8: the year by prefix, so ``2025.0`` is 2025."""
    return holds(text(c).startswith(str(year)))


def dates_within(df: DataFrame, c: str, low, high, drop_undated: bool = True) -> DataFrame:
    """inclusive; rows without a date go unless asked for."""
    inside = F.col(c).between(F.lit(low), F.lit(high))
    return df.where(holds(inside) if drop_undated else holds(inside) | F.col(c).isNull())


def cascade(df: DataFrame, choices: Mapping[str, object], everything: str = "All") -> DataFrame:
    """(field, option): for each field its distinct values under all other choices; one pass over the data."""
    ok = {c: F.lit(True) if v is None or v == everything else holds(F.col(c) == F.lit(v)) for c, v in choices.items()}

    def others(field: str) -> Column:
        out = F.lit(True)
        for c, p in ok.items():
            if c != field:
                out = out & p
        return out

    pairs = F.array(*(F.when(others(c), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("option"))) for c in choices))
    return df.select(F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("p")).select("p.field", "p.option").where("option is not null").distinct()


def overdue(df: DataFrame, pending: str, deadline: str, as_of) -> DataFrame:
    """F12."""
    return df.where(holds((F.col(pending) > 0) & (F.col(deadline) < F.lit(as_of).cast("date"))))


def search(df: DataFrame, query: str, columns: Sequence[str] | None = None) -> DataFrame:
    """rows where any column matches a pattern, in any case."""
    return df.where(F.exists(F.array(*(text(F.col(f"`{c}`")) for c in columns or df.columns)), lambda x: x.rlike(f"(?i){query}")))


def search_plain(df: DataFrame, query: str, columns: Sequence[str] | None = None) -> DataFrame:
    """rows whose joined text holds a plain text, in any case."""
    return df.where(F.lower(F.concat_ws(" ", *(text(F.col(f"`{c}`")) for c in columns or df.columns))).contains(query.lower()))


def gpa_complete(programme: Column, lateral: Column, gpas: Mapping[int, Column]) -> Column:
    """whether the semester averages that a student must have are there.

    ``gpas``: by semester, those the report has. A master's programme starts with M; a report without semesters 5 and
    6 is one too. Lateral entrants need semesters 3 and 4 there; else 5 and 6, and 3 exactly if 4.
    """
    there = lambda n: (~blank(gpas[n]) & (F.lower(strip(gpas[n])) != "nan")) if n in gpas else F.lit(False)
    master = F.upper(strip(programme)).startswith("M") | F.lit(5 not in gpas and 6 not in gpas)
    every = F.lit(True)
    for n in gpas:
        every = every & there(n)
    late = F.lower(text(lateral)).contains("lateral admission")
    return F.when(late & master, there(3) & there(4)).when(late, there(5) & there(6) & (there(3) == there(4))).otherwise(every)


def in_group_any(df: DataFrame, keys: Sequence[str], flag: Column, keep: Column) -> DataFrame:
    """In groups with a flagged row only rows that satisfy ``keep``; other groups whole."""
    has = F.max(F.when(holds(flag), 1).otherwise(0)).over(Window.partitionBy(*keys))
    return df.withColumn("__has", has).where((F.col("__has") == 0) | holds(keep)).drop("__has")


def of_entities(df: DataFrame, key: str, having: Column) -> DataFrame:
    """all rows of the entities that have a row with ``having``."""
    return df.join(df.where(having).select(key).distinct(), key, "left_semi")


# Fixed values of the format (F28): phrases of headers and lines that say nothing of a student; institution names are the caller's to add.
NOISE = ("Module Credits", "Consolidated Result", "COURSE DETAILS", "Candidate's Full Name", "MRK G GP C", "CG ; CG ;")
NOISE_PATTERN = r"(?i)^\s*/\s*:\s*Female|Grade\s+Marks\s+GP|Date:\s*\(Execution|Page:\s*\d+/\d+|CONTROLLER OF EXAMINATIONS|PRINCIPAL"


def content_lines(lines: DataFrame, column: str = "text", phrases: Sequence[str] = NOISE) -> DataFrame:
    """trimmed lines without rules, header phrases and signature lines."""
    s = strip(F.col(column))
    said = F.lit(False)
    for p in phrases:
        said = said | s.contains(p)
    return lines.withColumn(column, s).where((F.col(column) != "") & ~s.rlike(r"^[-_=\s]+$") & ~said & ~s.rlike(NOISE_PATTERN))
