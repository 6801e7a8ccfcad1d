"""SpreadsheetML (XML) tables, read row by row by many tasks.

Files are cut at ``</Row>`` by Spark's text reader, which splits a file among tasks; a record is what stands up to the end of
a row, so it may open worksheets and hold rows without cells before its own. Where a row stands follows from all rows
before it, as any row may name its place: running numbers by a prefix scan over the records in their order, which no
task sees whole. Cells are parsed by Spark's XML reader.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.operators.reshape import cell_positions
from markbook.operators.scan import Ordered

CELLS = "struct<Cell:array<struct<`_ss:Index`:int,`_ss:MergeAcross`:int,`_ss:MergeDown`:int,Data:struct<_VALUE:string>>>>"
#: What opens a worksheet or a row, and what ends a row.
OPENS, END = r"<(?:Row|Worksheet)\b[^>]*>", "</Row>"
ORDER = ("path", "start", "record", "place")


def _index(tag: Column) -> Column:
    return F.regexp_extract(tag, r'\sss:Index\s*=\s*["\']([0-9]+)["\']', 1).try_cast("int")


def rows(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, sheet_no, row, cells): rows of all worksheets by their places from 0; cells as parsed."""
    lines = spark.read.option("lineSep", END).text(path if isinstance(path, str) else list(path))
    records = lines.select("_metadata.file_path", "_metadata.file_block_start", "value").toDF("path", "start", "value").withColumn("record", F.monotonically_increasing_id())
    tags = records.select("*", F.posexplode(F.regexp_extract_all("value", F.lit(OPENS), F.lit(0))).alias("place", "tag"))
    body = F.concat(F.lit("<Row"), F.element_at(F.split("value", r"<Row\b"), -1), F.lit(END))
    marks = tags.select(*ORDER, F.startswith("tag", F.lit("<Worksheet")).alias("opens"), _index(F.col("tag")).alias("index"), F.when(~F.endswith("tag", F.lit("/>")), body).alias("xml"))
    found = Ordered(marks, ORDER).running("sheet", F.col("opens").cast("int")).running("n", (~F.col("opens")).cast("int"))
    anchor = F.when(F.col("opens"), -1 - F.col("n")).when(F.col("index").isNotNull(), F.col("index") - 1 - F.col("n"))
    placed = found.last("base", anchor).where("not opens").rows
    first = placed.groupBy("path").agg(F.min("sheet").alias("first"))
    parsed = F.from_xml("xml", CELLS, {"mode": "PERMISSIVE"})["Cell"]
    return placed.join(first, "path").select("path", (F.col("sheet") - F.col("first")).cast("int").alias("sheet_no"), (F.col("base") + F.col("n")).cast("int").alias("row"), parsed.alias("cells"))


def cells(spark: SparkSession, path: str | Sequence[str], every_sheet: bool = False) -> DataFrame:
    """(path, sheet_no, row, column, text, merge_across, merge_down), sparse cells placed; the first worksheet of each file, or all."""
    found = rows(spark, path).where("cells is not null")
    found = found if every_sheet else found.where("sheet_no = 0")
    at = cell_positions(F.transform("cells", lambda x: F.struct(x["_ss:Index"].alias("index"), x["_ss:MergeAcross"].alias("span"))))
    each = found.select("path", "sheet_no", "row", F.explode(F.arrays_zip(F.col("cells").alias("c"), at.alias("at"))).alias("z"))
    span = lambda n: F.coalesce(F.col(f"z.c.`_ss:{n}`"), F.lit(0))
    text = F.trim(F.coalesce(F.col("z.c.Data._VALUE"), F.lit("")))
    return each.select("path", "sheet_no", "row", F.col("z.at").alias("column"), text.alias("text"), span("MergeAcross").alias("merge_across"), span("MergeDown").alias("merge_down"))


def covered(found: DataFrame, keys: Sequence[str] = ("path", "sheet_no")) -> DataFrame:
    """(keys, row, column, text, owner_row, owner_column): every place of the grid that a cell stands on or is merged over.

    A cell covers the columns of its span and the rows of its interval; of cells that cover one place the first in reading
    order owns it. The places of all cells are no more than those of the grid, but for overlaps.
    """
    wide = found.select(*keys, F.struct(F.col("row").alias("owner_row"), F.col("column").alias("owner_column"), "text").alias("o"), "merge_down", "row", F.explode(F.sequence("column", F.col("column") + F.col("merge_across"))).alias("at"))
    every = wide.select(*keys, F.explode(F.sequence("row", F.col("row") + F.col("merge_down"))).alias("row"), F.col("at").alias("column"), "o")
    return every.groupBy(*keys, "row", "column").agg(F.min("o").alias("o")).select(*keys, "row", "column", "o.text", "o.owner_row", "o.owner_column")


def joined_ids(row: Column, sep: str = "\n") -> Column:
    """A row's columns 1 to 3 (ids) as one, blank ones left out: (number, ids, name, rest)."""
    ids = F.array_join(F.filter(F.transform(F.slice(row, 2, 3), lambda x: F.trim(x)), lambda x: x != ""), sep)
    one = lambda i: F.trim(F.coalesce(F.get(row, i), F.lit("")))
    return F.concat(F.array(one(0), ids, one(4)), F.slice(row, F.lit(6), F.greatest(F.size(row) - 5, F.lit(0))))


def widths(found: DataFrame, columns: DataFrame, keys: Sequence[str] = ("path", "sheet_no")) -> DataFrame:
    """The cells with ``width``: that of their whole span, from ``columns`` (keys, start, end, width) runs of equal columns.

    A span's width is the difference of the widths before its two ends; runs are few (one a declared column), cells are many.
    """
    total = lambda upto: F.aggregate("runs", F.lit(0.0), lambda s, r: s + r["width"] * F.greatest(F.least(upto, r["end"] + 1) - r["start"], F.lit(0)))
    runs = columns.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end", "width"))).alias("runs"))
    met = found.join(runs, list(keys), "left")
    end = F.col("column") + F.col("merge_across") + 1
    return met.withColumn("width", F.coalesce(total(end) - total(F.col("column")), F.lit(0.0))).drop("runs")
