"""Long and wide forms. Wide forms take their values explicitly, so no extra pass finds them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.functions.text import let


def crosstab_sum(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, measure: str, total: str | None = "total") -> DataFrame:
    """Sums by row and column value, absent cells 0, and the total over the given values."""
    wide = df.groupBy(*rows).pivot(column, list(values)).agg(F.sum(measure))
    wide = wide.select(*rows, *(F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(str(v)) for v in values))
    return wide if total is None else wide.withColumn(total, sum((F.col(f"`{v}`") for v in values), F.lit(0)))


def crosstab_text(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, item: Column, order: Sequence[Column], sep: str = " / ", empty: str = "--") -> DataFrame:
    """The items of a cell in order, joined; ``empty`` where there is none."""
    packed = F.sort_array(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), item.alias("item"))))
    wide = df.groupBy(*rows).pivot(column, list(values)).agg(F.array_join(F.transform(packed, lambda s: s["item"]), sep))
    return wide.select(*rows, *(F.coalesce(F.nullif(F.col(f"`{v}`"), F.lit("")), F.lit(empty)).alias(str(v)) for v in values))


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """Wide marks as rows."""
    return df.unpivot(list(ids), list(columns), name, value)


def numbered_wide(df: DataFrame, keys: Sequence[str], array: str, fields: Sequence[str], n: int, prefix: str = "Sub") -> DataFrame:
    """M1: struct list as ``Sub1 field ... SubN field``."""
    cell = lambda i, f: F.try_element_at(F.col(array), F.lit(i))[f].alias(f"{prefix}{i} {f}")
    return df.select(*keys, *(cell(i, f) for i in range(1, n + 1) for f in fields))


def exploded(df: DataFrame, keys: Sequence[str], array: str, position: str = "position") -> DataFrame:
    """M1: struct list as rows, numbered from 1."""
    return df.select(*keys, F.posexplode(array).alias(position, "item")).select(*keys, (F.col(position) + 1).alias(position), "item.*")


def zipped(lists: Mapping[str, Column]) -> Column:
    """M2: parallel lists as one list of structs, short ones padded with blanks."""
    return F.transform(F.arrays_zip(*(c.alias(k) for k, c in lists.items())), lambda s: F.struct(*(F.coalesce(s[k], F.lit("")).alias(k) for k in lists)))


def cell_positions(cells: Column) -> Column:
    """M3: columns (from 0) of cells with optional ``index`` (from 1) and ``span`` (further cells taken)."""
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("at"))

    def step(s: Column, c: Column) -> Column:
        here = F.coalesce(c["index"].cast("int") - 1, s["next"])
        return F.struct((here + 1 + F.coalesce(c["span"].cast("int"), F.lit(0))).alias("next"), F.concat(s["at"], F.array(here)).alias("at"))

    return F.aggregate(cells, start, step, lambda s: s["at"])


def once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``df`` with columns that are computed once a row, however often they are used later: a generator keeps the optimizer
    from putting their expressions in place of their names."""
    made = F.explode(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))).alias("__once")
    return df.select("*", made).select(*(f"`{c}`" for c in df.columns if c not in columns), "__once.*")


def pipe_cells(line: Column, label: str = "") -> Column:
    """M4: trimmed cells of a ``|`` row without its label; one empty cell at the end goes."""
    s = F.trim(F.coalesce(line, F.lit("")))
    body = F.when(s.startswith(label), F.substr(s, F.lit(len(label) + 1))).otherwise(s) if label else s
    cells = F.transform(F.split(body, r"\|", -1), lambda x: F.trim(x))
    return let(cells, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x))


def semester_map(keys: Column, values: Column) -> Column:
    """M6: map of semester to metric, without blank semesters."""
    pairs = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda s: F.trim(s["k"]) != "")
    return F.map_from_entries(F.transform(pairs, lambda s: F.struct(s["k"], s["v"])))
