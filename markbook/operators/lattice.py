"""Types of text columns over many files, as a lattice whose joins are a bitwise or, so states combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a value may be, a bit each; a column's state is the or of its values'. Null and blank are no bit.
LONG, DOUBLE, DATE, STAMP, TRUTH, TEXT = 1, 2, 4, 8, 16, 32
#: Types by state; every other state is text.
TYPES = {0: "string", LONG: "bigint", DOUBLE: "double", LONG | DOUBLE: "double", DATE: "date", STAMP: "timestamp", DATE | STAMP: "timestamp", TRUTH: "boolean"}
#: Columns that a union of files may have, by the format.
MOST_COLUMNS = 16_384


def kind(text: Column) -> Column:
    """The bit of a value. Digits with leading zeros, or more than a number holds, are text."""
    t = F.trim(text)
    whole = t.rlike(r"^[+-]?(0|[1-9][0-9]{0,17})$")
    real = t.rlike(r"^[+-]?(0|[1-9][0-9]{0,14})?\.[0-9]+([eE][+-]?[0-9]{1,3})?$|^[+-]?[1-9][0-9]*[eE][+-]?[0-9]{1,3}$")
    day = t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & t.try_cast("date").isNotNull()
    stamp = t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?$") & t.try_cast("timestamp").isNotNull()
    bit = F.when(whole, LONG).when(real, DOUBLE).when(day, DATE).when(stamp, STAMP).when(F.lower(t).isin("true", "false"), TRUTH).otherwise(TEXT)
    return F.when(t.isNull() | (t == ""), 0).otherwise(bit)


def headers(rows: DataFrame, keys: Sequence[str] = ("path", "sheet_no")) -> DataFrame:
    """(keys, names): the first row of every sheet; blank names are ``Column1``, ``Column2``, ..., repeated ones get ``_2``, ``_3``, ..."""
    plain = F.transform("cells", lambda x, i: F.coalesce(F.nullif(F.trim(F.regexp_replace(x, r"[\s ]+", " ")), F.lit("")), F.concat(F.lit("Column"), (i + 1).cast("string"))))
    named = rows.where("_row_no = 0").select(*keys, plain.alias("plain"))
    before = lambda i: F.size(F.filter(F.slice("plain", F.lit(1), i), lambda y: F.lower(y) == F.lower(F.get("plain", i))))
    return named.select(*keys, F.transform("plain", lambda x, i: F.when(before(i) > 0, F.concat(x, F.lit("_"), (before(i) + 1).cast("string"))).otherwise(x)).alias("names"))


def inferred(rows: DataFrame, keys: Sequence[str] = ("path", "sheet_no")) -> DataFrame:
    """(keys, column, name, state, type) of every column of every sheet."""
    cells = rows.where("_row_no > 0").select(*keys, F.posexplode(F.transform("cells", kind)).alias("column", "bit"))
    states = cells.groupBy(*keys, "column").agg(F.bit_or("bit").alias("state"))
    names = headers(rows, keys).select(*keys, F.posexplode("names").alias("column", "name"))
    found = names.join(states, [*keys, "column"], "left").withColumn("state", F.coalesce("state", F.lit(0)))
    return found.withColumn("type", type_of(F.col("state")))


def type_of(state: Column) -> Column:
    out = F.lit("string")
    for bits, name in TYPES.items():
        out = F.when(state == bits, name).otherwise(out)
    return out


def typed_union(rows: DataFrame, keys: Sequence[str] = ("path", "sheet_no")) -> DataFrame:
    """All sheets below each other by name, every column of the type that fits all files; keys and ``_row_no`` first.

    Two passes: types, then one projection. Names come to the driver, MOST_COLUMNS at most.
    """
    found = inferred(rows, keys)
    joint = found.groupBy("name").agg(F.bit_or("state").alias("state"), F.min("column").alias("place")).withColumn("type", type_of(F.col("state")))
    columns = joint.orderBy("place", "name").limit(MOST_COLUMNS + 1).collect()
    if len(columns) > MOST_COLUMNS:
        raise ValueError(f"the files have more than {MOST_COLUMNS} columns")
    met = rows.where("_row_no > 0").join(headers(rows, keys), list(keys))
    cell = lambda name: F.get("cells", (F.array_position("names", F.lit(name)) - 1).cast("int"))
    return met.select(*keys, "_row_no", *(cell(r.name).try_cast(r.type).alias(r.name) if r.type != "string" else cell(r.name).alias(r.name) for r in columns))
