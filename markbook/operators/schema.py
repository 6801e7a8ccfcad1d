"""Header resolution: logical names to the columns a file really has. Runs on the driver, over names only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a header is folded before it is compared, by policy name.
FOLDS: dict[str, Callable[[str], str]] = {
    "exact": lambda h: h,
    "alnum": lambda h: re.sub(r"[^a-z0-9]", "", h.lower()),
    "nospace": lambda h: re.sub(r"\s+", "", h.lower()),
    "words": lambda h: re.sub(r"\s+", " ", h.replace(" ", " ")).strip().lower(),
}


class MissingColumns(ValueError):
    """Required columns that a frame lacks."""

    def __init__(self, names: Sequence[str]):
        super().__init__("missing columns: " + ", ".join(names))
        self.names = list(names)


def clean_name(name: str) -> str:
    """Trimmed, no-break spaces and runs of white space as one space."""
    return re.sub(r"\s+", " ", str(name).replace(" ", " ")).strip()


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names([clean_name(c) for c in df.columns]))


def unique_names(names: Iterable[str]) -> list[str]:
    """Repeated names get ``_2``, ``_3``, ... (K18, also for sheets)."""
    seen: set[str] = set()
    out = []
    for n in names:
        name, k = n, 2
        while name.lower() in seen:
            name, k = f"{n}_{k}", k + 1
        seen.add(name.lower())
        out.append(name)
    return out


def find(columns: Sequence[str], candidates: Sequence[str], fold: str = "alnum", on_duplicate: str = "first", prefix: bool = False) -> str | None:
    """The column that equals a candidate after folding, candidates in order; optionally one that starts with it."""
    f = FOLDS[fold]
    order = columns if on_duplicate == "first" else list(reversed(columns))
    for test in (lambda h, c: f(h) == f(c), lambda h, c: prefix and f(h).startswith(f(c))):
        for c in candidates:
            if hit := next((h for h in order if test(h, c)), None):
                return hit
    return None


def find_containing(columns: Sequence[str], groups: Sequence[Sequence[str]], fallback: int | None = None) -> str | None:
    """The first column that holds all keywords of a group, groups in order; else the column at ``fallback``."""
    for group in groups:
        for h in columns:
            if all(k.lower() in h.lower() for k in group):
                return h
    return columns[fallback] if fallback is not None and len(columns) > fallback else None


def bind(df: DataFrame, wanted: Mapping[str, Sequence[str]], required: Sequence[str] = (), **how) -> DataFrame:
    """Logical columns of ``wanted`` (name: aliases) in order, absent ones as null; raises for absent required ones."""
    found = {k: find(df.columns, [k, *v], **how) for k, v in wanted.items()}
    if lost := [k for k in required if found[k] is None]:
        raise MissingColumns(lost)
    return df.select(*((F.col(f"`{h}`") if h else F.lit(None).cast("string")).alias(k) for k, h in found.items()))


def canonical_casing(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """One spelling of every header over all frames, the first seen; twins inside a frame are coalesced."""
    spelling: dict[str, str] = {}
    out = []
    for df in frames:
        groups: dict[str, list[str]] = {}
        for c in df.columns:
            groups.setdefault(spelling.setdefault(clean_name(c).lower(), clean_name(c)), []).append(c)
        out.append(df.select(*(F.coalesce(*(F.col(f"`{x}`") for x in cs)).alias(name) for name, cs in groups.items())))
    return out


def metric_columns(columns: Sequence[str], fixed: Sequence[str]) -> list[str]:
    """C11: the columns that aren't fixed ones."""
    return [c for c in columns if c not in set(fixed)]


def header_maximum(columns: Sequence[str]) -> float:
    """C11: sum of the maxima in headers such as ``Q1 (10)``."""
    return sum(float(m[1]) for c in columns if (m := re.search(r"\(\s*(\d+(?:\.\d+)?)\s*\)\s*$", c)))


def move_after(df: DataFrame, block: Sequence[str], anchor: str) -> DataFrame:
    """``block`` right after ``anchor``."""
    rest = [c for c in df.columns if c not in set(block)]
    at = rest.index(anchor) + 1 if anchor in rest else len(rest)
    return df.select(*(f"`{c}`" for c in [*rest[:at], *(c for c in block if c in df.columns), *rest[at:]]))


def present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Those of ``names`` that exist, in that order."""
    return df.select(*(f"`{c}`" for c in names if c in df.columns))


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Renames what exists."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def dynamic_names(df: DataFrame, maps: str) -> list[str]:
    """The sorted distinct keys of a map column; the set of keys is that of a header."""
    return sorted(r[0] for r in df.select(F.explode(F.map_keys(maps))).distinct().collect())


ROMAN = {x: i for i, x in enumerate(("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"), 1)}


def semester_rank(name: str) -> int:
    """Order of a semester: Roman, else Arabic, else last."""
    s = name.strip().upper()
    return ROMAN.get(s, int(s) if s.isdigit() else 99)


def section_order(columns: Sequence[str], ids: Sequence[str], totals: Sequence[str], finals: Sequence[str]) -> list[str]:
    """C17: ids, subject columns, semesters in order, totals, finals, the rest."""

    def key(c: str) -> tuple:
        if c in ids:
            return (0, ids.index(c), 0, "")
        if m := re.match(r"Sub(\d+)", c):
            return (1, int(m[1]), 0, "")
        if m := re.match(r"Sem[_ ](\w+?)[_ ]", c):
            return (2, semester_rank(m[1]), 0, "")
        if c in totals:
            return (3, totals.index(c), 0, "")
        return (4, finals.index(c), 0, "") if c in finals else (5, 0, 0, "")

    return sorted(columns, key=key)


def without_blank_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are blank in every row; one pass."""
    has = df.agg(*(F.max(F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", 1).otherwise(0)).alias(f"c{i}") for i, c in enumerate(df.columns))).first()
    return df.select(*(f"`{c}`" for i, c in enumerate(df.columns) if has[i]))


def conform(df: DataFrame, names: Sequence[str], default: str | int = "") -> DataFrame:
    """Exactly ``names``; absent columns and nulls as ``default``."""
    return df.select(*((F.coalesce(F.col(f"`{c}`"), F.lit(default)) if c in df.columns else F.lit(default)).alias(c) for c in names))


def width_profile(df: DataFrame, pad: int = 2, least: int = 8, most: int = 60) -> DataFrame:
    """(column, width): the longest text of each column, padded and clamped, in one pass."""
    longest = df.agg(*(F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)).alias(f"c{i}") for i, c in enumerate(df.columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.greatest(F.col(f"c{i}"), F.lit(len(c))).alias("n")) for i, c in enumerate(df.columns)))
    return longest.select(F.explode(rows).alias("r")).select("r.column", F.greatest(F.lit(least), F.least(F.lit(most), F.col("r.n") + pad)).alias("width"))
