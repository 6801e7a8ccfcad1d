"""Column expressions over numbers held as text, marks and grades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from markbook.functions.text import strip, text

NUMERIC = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(c: Column) -> Column:
    """The number a text holds, else null. Type letters such as ``1d`` are no numbers."""
    s = text(c)
    return F.when(s.rlike(NUMERIC), F.trim(s).try_cast("double"))


def number_or_zero(c: Column) -> Column:
    return F.coalesce(number(c), F.lit(0.0))


def count_of(c: Column) -> Column:
    """Whole count, invalid as 0."""
    return number_or_zero(c).cast("long")


def first_number(c: Column) -> Column:
    """The first run of digits as an integer, else null."""
    return F.nullif(F.regexp_extract(text(c), "([0-9]+)", 1), F.lit("")).try_cast("int")


def scale_max(c: Column) -> Column:
    """Largest mark of a scale such as ``R050``, 0 without digits."""
    return F.coalesce(first_number(c), F.lit(0))


def mark(c: Column) -> Column:
    """struct(display, value, special): absent and unfair-means codes, blanks, numbers and other text."""
    s = F.upper(strip(c))
    code = F.when(s.isin("Z1", "AB"), "AB").when(s.isin("Z3", "UFM"), "UFM")
    value = number(c)
    whole = F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))
    return F.struct(F.coalesce(code, whole, strip(c)).alias("display"), F.when(code.isNull(), value).alias("value"), code.isNotNull().alias("special"))


def failed(value: Column, largest: Column, special: Column, share: float = 0.4) -> Column:
    """Below ``share`` of a positive maximum (strictly), or absent."""
    return F.coalesce(special, F.lit(False)) | F.coalesce((largest > 0) & (value < largest * share), F.lit(False))


def mismatch(parts: Sequence[Column], whole: Column, tolerance: float = 0.01) -> Column:
    """Whether the parts don't add up to a given whole."""
    return F.coalesce(F.abs(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) - whole) >= tolerance, F.lit(False))


def quota(n: Column, share: float = 0.05) -> Column:
    """Round half up of ``share`` of n, one at least."""
    return F.greatest(F.lit(1), F.floor(n * share + 0.5).cast("long"))


# Least percentage of each grade, and the ranks of grades.
LADDER = ((90, "O"), (80, "A+"), (70, "A"), (60, "B+"), (55, "B"), (50, "C"), (40, "P"))
GRADE_RANKS = {"O": 8, "A+": 7, "A": 6, "B+": 5, "B": 4, "C": 3, "P": 2, "F": 1}


def grade(obtained: Column, largest: Column) -> Column:
    """Grade of a percentage, blank if either is missing or the maximum isn't positive."""
    pct = F.when(largest > 0, obtained / largest * 100.0)
    out = F.when(pct.isNull(), "")
    for least, name in LADDER:
        out = out.when(pct >= least, name)
    return out.otherwise("F")


def grade_rank(c: Column) -> Column:
    """Ordinal of a grade, null for other text."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in GRADE_RANKS.items() for x in kv)), F.upper(strip(c)))


def total_obtained(score: Column, internal: Column) -> Column:
    """Sum with a missing side as 0; null if both are blank. A leading plus of the internal mark is ignored."""
    own = number_or_zero(F.regexp_replace(strip(internal), r"^\+\s*", ""))
    return F.when((strip(score) == "") & (strip(internal) == ""), F.lit(None)).otherwise(number_or_zero(score) + own)


def change_percent(before: Column, after: Column, *largest: Column) -> Column:
    """Change in percent of the first positive maximum, two places; null if a score isn't a number."""
    base = F.coalesce(*(F.when(m > 0, m) for m in largest))
    return F.round((after - before) / base * 100.0, 2)


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """A3: share in percent, 0 if the whole is 0 or missing."""
    return F.round(F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0)), places)


def direction(after: Column, before: Column) -> Column:
    """Up, down (also if the later mark is gone) or same; null if they can't be compared."""
    return F.when(after.isNull() & before.isNotNull(), "down").when(after > before, "up").when(after < before, "down").when(after == before, "same")


def same_number(a: Column, b: Column) -> Column:
    """Numeric equality of two texts, a leading plus ignored; null unless both are numbers."""
    plain = lambda c: number(F.regexp_replace(strip(c), r"^\+\s*", ""))
    return plain(a) == plain(b)


def split_ratio(c: Column) -> Column:
    """struct(obtained, largest) of ``obtained/max``."""
    s = text(c)
    side = lambda i: F.when(s.contains("/"), strip(F.split_part(s, F.lit("/"), F.lit(i)))).otherwise("")
    return F.struct(side(1).alias("obtained"), side(2).alias("largest"))


def grade_points(given: Column, points: Column, credits: Column) -> Column:
    """Credit points as given, else points x credits."""
    return F.coalesce(number(given), number(points) * number(credits))


def percent_or(given: Column, obtained: Column, largest: Column) -> Column:
    """A given percentage without its sign, else computed to two places."""
    return F.coalesce(number(F.replace(text(given), F.lit("%"), F.lit(""))), F.round(F.try_divide(obtained * 100.0, largest), 2))
