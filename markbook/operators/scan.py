"""Prefix scans over one long order, without a window over all rows.

Rows are dealt in ranges of their order and written once, so a range is the same whenever it is read. Each state (a running
sum, the last value, the row before) is combined within ranges before any shuffle; only one state a range comes to the
driver, where those before each range are added up, and goes back as a broadcast of that many rows. Windows then run inside
ranges. The number of ranges is that of the shuffle partitions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markbook.session import written

RANGE = "__range"


class Ordered:
    """A frame in a complete order (no ties), null first; methods give the frame with one more column."""

    def __init__(self, df: DataFrame, order: Sequence[str]):
        self.order = list(order)
        dealt = df.repartitionByRange(*(F.col(f"`{c}`").asc_nulls_first() for c in order)).withColumn(RANGE, F.spark_partition_id())
        self.df = written(dealt, "ranges")

    def _with(self, df: DataFrame) -> Ordered:
        out = object.__new__(Ordered)
        out.order, out.df = self.order, df
        return out

    @property
    def window(self):
        return Window.partitionBy(RANGE).orderBy(*(F.col(f"`{c}`").asc_nulls_first() for c in self.order))

    @property
    def rows(self) -> DataFrame:
        return self.df.drop(RANGE)

    def where(self, kept: Column | str) -> Ordered:
        return self._with(self.df.where(kept))

    def select(self, *columns) -> Ordered:
        return self._with(self.df.select(*columns, RANGE))

    def column(self, name: str, value: Column) -> Ordered:
        return self._with(self.df.withColumn(name, value))

    def _carried(self, state: Column, add: Callable) -> DataFrame:
        """(range, carry): the states of all ranges before each, added up from null."""
        got = self.df.groupBy(RANGE).agg(state.alias("state"))
        kind, before, out = got.schema["state"].dataType, None, []
        for r in sorted(got.collect(), key=lambda r: r[0]):  # one row a range
            out.append((r[0], before))
            before = add(before, r[1])
        return F.broadcast(self.df.sparkSession.createDataFrame(out, got.select(F.col(RANGE).alias("__of"), F.col("state").alias("__carry")).schema if out else f"__of int, __carry {kind.simpleString()}"))

    def _joined(self, carried: DataFrame, made: Callable[[Column], Column], name: str) -> Ordered:
        own = [c for c in self.df.columns if c != name]
        met = self.df.join(carried, F.col(RANGE) == F.col("__of"), "left")
        return self._with(met.withColumn(name, made(F.col("__carry"))).select(*(f"`{c}`" for c in own), f"`{name}`"))

    def running(self, name: str, value: Column) -> Ordered:
        """The sum of ``value`` over this row and all before; null adds nothing."""
        value = F.coalesce(value.cast("long"), F.lit(0).cast("long"))
        carried = self._carried(F.sum(value), lambda a, b: (a or 0) + (b or 0))
        w = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self._joined(carried, lambda carry: F.sum(value).over(w) + F.coalesce(carry, F.lit(0)), name)

    def last(self, name: str, value: Column) -> Ordered:
        """The last ``value`` that isn't null, of this row and all before."""
        held = F.struct(value.alias("v"))
        place = F.struct(*(F.col(f"`{c}`") for c in self.order))
        carried = self._carried(F.max_by(held, F.when(value.isNotNull(), place)), lambda a, b: b if b is not None and b[0] is not None else a)
        w = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self._joined(carried, lambda carry: F.coalesce(F.last(value, ignorenulls=True).over(w), carry["v"]), name)

    def previous(self, name: str, value: Column) -> Ordered:
        """struct(v): the ``value`` of the row before; null in the first row."""
        held = F.struct(value.alias("v"))
        place = F.struct(*(F.col(f"`{c}`") for c in self.order))
        carried = self._carried(F.max_by(held, place), lambda a, b: b)
        return self._joined(carried, lambda carry: F.coalesce(F.lag(held).over(self.window), carry), name)


def runs(df: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """(run, value, n): runs of equal neighbours over the whole frame, numbered from 1."""
    prior = Ordered(df.select(*order, value), order).previous("__before", F.col(value))
    same = F.coalesce(F.col("__before").isNotNull() & F.col("__before.v").eqNullSafe(F.col(value)), F.lit(False))
    return prior.running("run", (~same).cast("int")).df.groupBy("run", value).agg(F.count("*").alias("n"))


def segments(df: DataFrame, header: Column, order: Sequence[str], name: str = "segment") -> DataFrame:
    """Number of the block that a header row starts; rows before the first header go."""
    return Ordered(df, order).running(name, header.cast("int")).where(F.col(name) > 0).rows


def blocks(df: DataFrame, starts: Column, ends: Column, order: Sequence[str]) -> DataFrame:
    """Rows from a start row to its end row (``block`` numbered from 1); a block without an end goes."""
    flag = lambda p: F.coalesce(p, F.lit(False)).cast("int")
    marked = Ordered(df, order).column("__end", flag(ends)).running("block", flag(starts)).running("__ends", F.col("__end"))
    inside = marked.where("block > 0").column("__ends", F.col("__ends") - F.col("__end")).rows
    kept = inside.groupBy("block").agg(F.min("__ends").alias("__e0"), F.max("__end").alias("__closed")).where("__closed = 1").select("block", "__e0")
    return inside.join(kept, "block").where("__ends = __e0").select(*(f"`{c}`" for c in df.columns if c != "block"), "block")


def split_at(df: DataFrame, mark: Column, order: Sequence[str], name: str = "part") -> DataFrame:
    """``data`` before the first marked row, ``legend`` from it on."""
    seen = Ordered(df, order).running("__seen", mark.cast("int"))
    return seen.column(name, F.when(F.col("__seen") > 0, "legend").otherwise("data")).rows.drop("__seen")
