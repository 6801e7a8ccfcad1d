"""Queries over workbooks and SpreadsheetML that executors write from the driver's tables and read back, and over one long order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook import catalog
from markbook.catalog import c, query
from markbook.operators import lattice as L
from markbook.operators import scan as S
from markbook.plan_queries import gracing_sheet
from markbook.plans import gazette as GZ
from markbook.plans import gracing as GR
from markbook.session import shared_folder, written
from markbook.sources import sheetreader, spreadsheetml
from markbook.sources.sheetwriter import Sheet, write_workbooks

E = F.expr


def local(spark: SparkSession) -> str:
    """A new shared folder for workbooks."""
    return f"{shared_folder(spark).removeprefix('file://')}-workbooks"


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file", F.element_at(F.split("path", "/"), -1))


# Workbooks: lineitem in a file a month, read back; every fourth one also torn.


def months(t, spark) -> str:
    folder = local(spark)
    lines = t("lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_orderkey", "l_linenumber", c("l_quantity").cast("long").alias("quantity"), "l_returnflag", (c("l_discount") > 0.05).alias("reduced"), F.when(c("l_orderkey") % 3 > 0, F.concat(F.lit(" <Tax & "), c("l_linestatus"), F.lit("> "))).alias("note"))
    write_workbooks(folder, {"Lines": Sheet(lines, ["l_orderkey", "l_linenumber", "quantity", "l_returnflag"], continues=True), "Sums": Sheet(lines.groupBy("month", "l_returnflag").agg(F.sum("quantity").alias("total")), ["l_returnflag"])}, "month")
    return folder


@query("""SELECT strftime(l_shipdate, '%Y-%m') || '.xlsx' AS file, CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, l_returnflag, CASE WHEN l_discount > 0.05 THEN 'True' ELSE 'False' END AS reduced, CASE WHEN l_orderkey % 3 > 0 THEN ' <Tax & ' || l_linestatus || '> ' END AS note FROM lineitem""")
def workbook_lines(t, spark):
    """All lines, from a workbook a month, as text."""
    rows = named(sheetreader.read(spark, months(t, spark), pattern="*.xlsx").rows).where("_row_no > 0")
    names = ["l_orderkey", "l_linenumber", "quantity", "l_returnflag", "reduced", "note"]
    return rows.select("file", *(F.get("cells", i).alias(n) for i, n in enumerate(names)))


@query("""WITH n AS (SELECT strftime(l_shipdate, '%Y-%m') AS m, count(*) AS k, count(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY ALL)
SELECT m || '.xlsx' AS file, 'Lines' AS sheet, CAST(0 AS INT) AS sheet_no, CAST(k AS BIGINT) AS n, CAST(6 AS INT) AS width, CAST(k AS INT) AS last FROM n UNION ALL SELECT m || '.xlsx', 'Sums', 1, f, 2, f FROM n""")
def workbook_sheets(t, spark):
    """Rows, width and last row number of every sheet of every file."""
    rows = named(sheetreader.read(spark, months(t, spark), every_sheet=True, pattern="*.xlsx").rows)
    return rows.groupBy("file", "sheet", "sheet_no").agg((F.count("*") - 1).alias("n"), F.max(F.size("cells")).alias("width"), F.max("_row_no").alias("last"))


@query("""SELECT DISTINCT strftime(l_shipdate, '%Y-%m') || '.xlsx' AS file, month(l_shipdate) % 4 = 0 AS torn FROM lineitem""")
def workbook_rejects(t, spark):
    """Files whose second half is lost are rows of the rejects; the others are read."""
    from markbook.sources.sheetwriter import torn_copies

    whole = months(t, spark)
    folder = local(spark)
    torn_copies(spark, whole, folder, E("pmod(cast(substring(name, 6, 2) as int), 4) = 0"))
    got = sheetreader.read(spark, folder, pattern="*.xlsx")
    good, bad = (named(x).select("file").distinct() for x in got)
    return good.select("file", F.lit(False).alias("torn")).union(bad.select("file", F.lit(True).alias("torn")))


# Types: exports of orders a year; a column differs in kind between files.

EXPORTS = """WITH o AS (SELECT o_orderkey AS k, year(o_orderdate) AS y, o_orderdate, o_totalprice, o_custkey, o_orderstatus FROM orders) """


def exports(t, spark) -> DataFrame:
    odd = F.year("o_orderdate") % 2 == 1
    rows = t("orders").select(
        F.year("o_orderdate").alias("y"), c("o_orderkey").alias("Order"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), F.when(odd, F.floor("o_totalprice").cast("string")).otherwise(F.concat(F.floor("o_totalprice"), F.lit(".5"))).alias("Price"),
        F.when(odd, F.concat(F.lit("C"), c("o_custkey"))).otherwise(c("o_custkey").cast("string")).alias("Customer"), (c("o_orderstatus") == "F").alias("Done"), F.when(odd, F.lit(" ")).otherwise(F.lpad(c("o_orderkey").cast("string"), 12, "0")).alias("Code"), F.lit(None).cast("string").alias("Blank"),
    )
    folder = local(spark)
    write_workbooks(folder, {"Orders": Sheet(rows, ["Order"], continues=True)}, "y")
    return sheetreader.read(spark, folder, pattern="*.xlsx").rows


@query(EXPORTS + """, f AS (SELECT DISTINCT y, y % 2 = 1 AS odd FROM o) SELECT y || '.xlsx' AS file, x.name AS name, x.type AS type FROM (SELECT y, unnest([{'name': 'Order', 'type': 'bigint'}, {'name': 'Date', 'type': 'date'}, {'name': 'Price', 'type': CASE WHEN odd THEN 'bigint' ELSE 'double' END}, {'name': 'Customer', 'type': CASE WHEN odd THEN 'string' ELSE 'bigint' END},
 {'name': 'Done', 'type': 'boolean'}, {'name': 'Code', 'type': 'string'}, {'name': 'Blank', 'type': 'string'}]) AS x FROM f)""")
def workbook_types(t, spark):
    """Types of every column of every file."""
    return named(L.inferred(exports(t, spark))).select("file", "name", "type")


@query(EXPORTS + """SELECT y || '.xlsx' AS file, k AS "Order", CAST(o_orderdate AS DATE) AS "Date", CASE WHEN y % 2 = 1 THEN floor(o_totalprice) ELSE floor(o_totalprice) + 0.5 END AS "Price", CASE WHEN y % 2 = 1 THEN 'C' ELSE '' END || o_custkey AS "Customer",
 o_orderstatus = 'F' AS "Done", CASE WHEN y % 2 = 1 THEN ' ' ELSE lpad(CAST(k AS VARCHAR), 12, '0') END AS "Code", CAST(NULL AS VARCHAR) AS "Blank" FROM o""")
def workbook_typed_union(t, spark):
    """All files below each other, each column of the type that fits all of them."""
    return named(L.typed_union(exports(t, spark))).select("file", "Order", "Date", "Price", "Customer", "Done", "Code", "Blank")


# The gracing workbook, all sheets.

GRACING = {"gracing_processed": "Failed", "gracing_cases": "Graced cases", "gracing_by_subject": "By subject", "gracing_by_student": "By student", "gracing_failed": "Failed students"}
SHOWN = {
    "gracing_processed": ["student", "kind", "label", "credit", "internal", "actual", "grace", "composite", "grade", "red_internal", "red_sem", "red_grace", "red_composite", "points"], "gracing_cases": ["student", "module", "description", "grace", "actual", "semester", "composite", "grade"],
    "gracing_by_subject": ["module", "description", "n_entities", "total", "largest"], "gracing_by_student": ["student", "n", "items", "total"], "gracing_failed": ["student"],
}


def _gracing_sql() -> str:
    """The SQL of the sheets' queries; numbers as a workbook shows them."""
    known = catalog._ORACLE
    cell = lambda x: f"""coalesce(CASE WHEN CAST(q."{x}" AS VARCHAR) = 'true' THEN 'True' WHEN CAST(q."{x}" AS VARCHAR) = 'false' THEN 'False' ELSE CAST(q."{x}" AS VARCHAR) END, '')"""
    sheets = [f"SELECT '{GRACING[k]}' AS sheet, {' || chr(31) || '.join(map(cell, SHOWN[k]))} AS line FROM ({known[k]}) AS q" for k in GRACING]
    return " UNION ALL ".join(sheets)


@query(_gracing_sql())
def gracing_workbook(t, spark):
    """K3: processed students, graced cases, both summaries and the students who failed, as sheets of one workbook, read back."""
    sheet = gracing_sheet(t)
    failed, plain = written(GR.failed_students(sheet), "failed"), written(GR.graced_cases(sheet), "cases")  # each is used more than once
    cases = plain.withColumnsRenamed({"Student Number": "student", "Module Code": "module", "Module Desc": "description"})
    made = {
        "gracing_processed": Sheet(GR.processed(sheet, failed, ordered=False).withColumnRenamed("Student Number", "student").select(*SHOWN["gracing_processed"], "seq"), ["student", "kind", "seq"], ["seq"], continues=True),
        "gracing_cases": Sheet(cases.select(*SHOWN["gracing_cases"]), ["student", "module"], continues=True),
        "gracing_by_subject": Sheet(GR.subject_summary(plain).withColumnsRenamed({"Module Code": "module", "Module Desc": "description"}).select(*SHOWN["gracing_by_subject"]), ["module"]),
        "gracing_by_student": Sheet(GR.student_summary(plain).withColumnRenamed("Student Number", "student").select(*SHOWN["gracing_by_student"]), ["student"], continues=True),
        "gracing_failed": Sheet(failed.withColumnRenamed("Student Number", "student"), ["student"], continues=True),
    }
    folder = local(spark)
    write_workbooks(folder, {GRACING[k]: v for k, v in made.items()}, name="Gracing")
    rows = sheetreader.read(spark, f"{folder}/Gracing.xlsx", every_sheet=True, blank="").rows.where("_row_no > 0")
    return rows.select("sheet", F.array_join("cells", "\x1f").alias("line"))


# SpreadsheetML: a document for every thousand customers. A title row, then from row 4 on two rows a customer: key (over two
# rows), name (over two columns) and nation; then the segment below. Each tenth customer is followed by a row without cells.

SHEETML = """WITH r AS (SELECT c_custkey AS k, c_custkey // 1000 AS doc, c_name, c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_custkey // 1000 ORDER BY c_custkey) - 1 AS i FROM customer),
p AS (SELECT *, CAST(3 + 2 * i + i // 10 AS INT) AS a FROM r), """
CELLS_SQL = SHEETML + """x AS (SELECT doc, a AS row, 0 AS col, CAST(k AS VARCHAR) AS text, 0 AS across, 1 AS down FROM p UNION ALL SELECT doc, a, 1, c_name, 1, 0 FROM p UNION ALL SELECT doc, a, 4, CAST(c_nationkey AS VARCHAR), 0, 0 FROM p UNION ALL SELECT doc, a + 1, 2, c_mktsegment, 0, 0 FROM p
 UNION ALL SELECT DISTINCT doc, 0, 0, 'RESULT GAZETTE ' || doc, 4, 0 FROM p) """


def sheetml(t, spark) -> str:
    """Writes the documents as text, a file each."""
    from pyspark.sql import Window

    cell = lambda text, attrs="": F.concat(F.lit(f'<Cell{attrs}><Data ss:Type="String">'), text, F.lit("</Data></Cell>"))
    within = Window.partitionBy("doc").orderBy("c_custkey")
    customers = t("customer").withColumn("doc", E("c_custkey div 1000")).withColumn("i", F.row_number().over(within) - 1).withColumn("last", F.lead("c_custkey").over(within).isNull())
    first = F.concat(F.lit("<Row"), F.when(c("i") == 0, ' ss:Index="4"').otherwise(""), F.lit(">"), cell(c("c_custkey"), ' ss:MergeDown="1"'), cell(c("c_name"), ' ss:MergeAcross="1"'), cell(c("c_nationkey"), ' ss:Index="5"'), F.lit("</Row>"))
    rows = F.concat(first, F.lit('<Row ss:Height="12">'), cell(c("c_mktsegment"), ' ss:Index="3"'), F.lit("</Row>"), F.when(c("i") % 10 == 9, '<Row ss:Height="3"/>').otherwise(""))
    head = F.concat(F.lit('<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet ss:Name="Gazette"><Table><Column ss:Width="30"/><Row>'), cell(F.concat(F.lit("RESULT GAZETTE "), c("doc")), ' ss:MergeAcross="4"'), F.lit("</Row>\n"))
    tail = F.lit('\n</Table></Worksheet><Worksheet ss:Name="Other"><Table><Row><Cell><Data ss:Type="String">other</Data></Cell></Row></Table></Worksheet></Workbook>')
    # One frame, so that a document is one task's: over a union whose sides are dealt by ``doc`` already, Spark leaves a repartition out and may cut the sides apart.
    lines = customers.select("doc", "i", F.concat(F.when(c("i") == 0, head).otherwise(""), rows, F.when(c("last"), tail).otherwise("")).alias("line"))
    folder = shared_folder(spark)
    lines.repartition("doc").sortWithinPartitions("doc", "i").select("doc", "line").write.partitionBy("doc").text(folder)
    return folder


def of_doc(df: DataFrame) -> DataFrame:
    return df.withColumn("doc", F.regexp_extract("path", "/doc=([0-9]+)/", 1).cast("long"))


@query(CELLS_SQL + "SELECT doc, row, CAST(col AS INT) AS col, text, CAST(across AS INT) AS across, CAST(down AS INT) AS down FROM x")
def sheetml_cells(t, spark):
    """Cells of the first worksheets at their places."""
    return of_doc(spreadsheetml.cells(spark, sheetml(t, spark))).select("doc", "row", c("column").alias("col"), "text", c("merge_across").alias("across"), c("merge_down").alias("down"))


@query(CELLS_SQL + """, w AS (SELECT doc, row, down, col, text, unnest(range(CAST(across AS INT) + 1)) AS dc FROM x), v AS (SELECT doc, row, col, text, dc, unnest(range(CAST(down AS INT) + 1)) AS dr FROM w)
SELECT doc, CAST(row + dr AS INT) AS row, CAST(col + dc AS INT) AS col, text, CAST(row AS INT) AS owner_row FROM v""")
def sheetml_grid(t, spark):
    """Every place that a cell stands on or is merged over."""
    grid = spreadsheetml.covered(spreadsheetml.cells(spark, sheetml(t, spark)))
    return of_doc(grid).select("doc", "row", c("column").alias("col"), "text", "owner_row")


@query(SHEETML + """l AS (SELECT DISTINCT doc, 0 AS row, 'RESULT GAZETTE ' || doc AS text FROM p UNION ALL SELECT doc, a, CAST(k AS VARCHAR) || ' | ' || c_name || ' | ' || c_nationkey FROM p UNION ALL SELECT doc, a + 1, c_mktsegment FROM p),
s AS (SELECT *, sum(CASE WHEN text LIKE '% | 3%' THEN 1 ELSE 0 END) OVER w AS block, coalesce(sum(CASE WHEN text LIKE '%BUILDING%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ends FROM l WINDOW w AS (PARTITION BY doc ORDER BY row)),
f AS (SELECT *, min(ends) OVER (PARTITION BY doc, block) AS e0, max(CASE WHEN text LIKE '%BUILDING%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, block) AS closed FROM s WHERE block > 0)
SELECT doc, CAST(row AS INT) AS row, 'data' AS part, text FROM f WHERE ends = e0 AND closed = 1""")
def sheetml_blocks(t, spark):
    """From a row of nation 3 to the BUILDING row below it."""
    raw = spreadsheetml.cells(spark, sheetml(t, spark))
    return of_doc(GZ.xml_blocks(raw, " | 3", "BUILDING", ["path"])).select("doc", "row", "part", "text")


@query(SHEETML + """q AS (SELECT doc, CAST(a AS INT) AS row, CAST(k AS VARCHAR) AS number, c_name || chr(10) || c_name AS ids, CAST(c_nationkey AS VARCHAR) AS name FROM p) SELECT doc, row, number, ids, name FROM q""")
def sheetml_ids(t, spark):
    """Id columns of a grid's rows as one."""
    grid = spreadsheetml.covered(spreadsheetml.cells(spark, sheetml(t, spark))).where("row > 0 and owner_row = row")
    rows = grid.groupBy("path", "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("m")).where(F.map_contains_key("m", F.lit(4)))
    full = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    made = rows.withColumn("r", spreadsheetml.joined_ids(full))
    return of_doc(made).select("doc", "row", c("r")[0].alias("number"), c("r")[1].alias("ids"), c("r")[2].alias("name"))


# One long order: all events, without a key.


@query("""WITH m AS (SELECT event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (ORDER BY event_id)),
r AS (SELECT *, sum(ch) OVER (ORDER BY event_id) AS run FROM m) SELECT CAST(run AS BIGINT) AS run, event_type, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY ALL""")
def long_runs(t, spark):
    """W12 over all events as one sequence."""
    return S.runs(t("events").select("event_id", "event_type"), "event_type", ["event_id"])


@query("""WITH s AS (SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS segment FROM events) SELECT event_id, user_id, segment FROM s WHERE segment > 0""")
def long_segments(t, spark):
    """W14 over all events as one document."""
    return S.segments(t("events").select("event_id", "user_id", "event_type"), c("event_type") == "purchase", ["event_id"]).drop("event_type")


@query("""WITH s AS (SELECT event_id, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS block, coalesce(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ends FROM events WINDOW w AS (ORDER BY event_id)),
f AS (SELECT *, min(ends) OVER (PARTITION BY block) AS e0, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY block) AS closed FROM s WHERE block > 0)
SELECT event_id, event_type, CAST(block AS BIGINT) AS block FROM f WHERE ends = e0 AND closed = 1""")
def long_blocks(t, spark):
    """W17 over all events as one document: from a purchase to the first click after it."""
    return S.blocks(t("events").select("event_id", "event_type"), c("event_type") == "purchase", c("event_type") == "click", ["event_id"])


@query("""SELECT event_id, CASE WHEN max(CASE WHEN user_id = 7 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) = 1 THEN 'legend' ELSE 'data' END AS part FROM events""")
def long_split(t, spark):
    """W18 over all events as one document."""
    return S.split_at(t("events").select("event_id", "user_id"), c("user_id") == 7, ["event_id"]).drop("user_id")
