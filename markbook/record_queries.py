"""Queries over a folder taken in by steps, a log of edits, timetable grids of discovered columns and widths of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.catalog import c, query
from markbook.operators import changes as CH
from markbook.plans import timetable as TT
from markbook.session import shared_folder
from markbook.sources import intake, sheetreader, spreadsheetml
from markbook.workbook_queries import local

E = F.expr


# Intake: events in a file a type and hundred users; odd types come later.


@query("""SELECT event_type AS type, CAST(count(*) AS BIGINT) AS n, CASE WHEN length(event_type) % 2 = 0 THEN 1 ELSE 2 END AS step FROM events GROUP BY event_type""")
def intake_steps(t, spark):
    """Two steps over a folder that grows; a third one, done again after the second, finds nothing and changes nothing."""
    folder, manifest = shared_folder(spark), shared_folder(spark)
    lines = t("events").select(F.to_json(F.struct("event_id", "event_type")).alias("value"), c("event_type").alias("type"))
    out = None
    for no, some in ((1, "length(type) % 2 = 0"), (2, "length(type) % 2 = 1"), (3, "false")):
        lines.where(some).write.mode("append").partitionBy("type").text(folder)
        taken = intake.step(spark, folder, manifest, "*.txt")
        if not taken.n:
            continue
        rows = spark.read.text(taken.paths()).select(F.from_json("value", "event_id long, event_type string").alias("e"))
        counted = rows.groupBy(c("e.event_type").alias("type")).agg(F.count("*").alias("n")).withColumn("step", F.lit(no))
        out = counted if out is None else out.union(counted)
        taken.record()
        taken.record()
    return out


# Edits: events as changes to a part's name; users stand for parts, every fifth edit deletes, one key has most of the edits.

EDITS = """WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id % 150 END AS k, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS v, date_trunc('minute', ts) AS tm, event_id FROM events),
l AS (SELECT k, tm, arg_max(v, event_id) AS v FROM e GROUP BY ALL), h AS (SELECT k, tm, nullif(v, '') AS v FROM l), p AS (SELECT *, lag(v) OVER w AS pv, row_number() OVER w AS n FROM h WINDOW w AS (PARTITION BY k ORDER BY tm)),
g AS (SELECT k, tm, v FROM p WHERE (n = 1 AND v IS NOT NULL) OR (n > 1 AND v IS DISTINCT FROM pv)), i AS (SELECT k, v, tm, lead(tm) OVER (PARTITION BY k ORDER BY tm) AS until FROM g) """


def edits(t) -> DataFrame:
    key = F.when(c("event_id") % 3 == 0, 1).otherwise(c("user_id") % 150).cast("long")
    rows = t("events").select(key.alias("k"), F.when(c("event_id") % 5 == 0, " ").otherwise(c("event_type")).alias("v"), F.date_trunc("minute", "ts").alias("at"), "event_id")
    return CH.compacted(rows, "k", "v", "at", "event_id")


@query(EDITS + "SELECT k AS key, v AS value, strftime(tm, '%Y-%m-%d %H:%M') AS since, strftime(until, '%Y-%m-%d %H:%M') AS until FROM i WHERE v IS NOT NULL")
def edit_intervals(t, spark):
    """Times for which each value holds."""
    shown = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm")
    return edits(t).select("key", "value", shown("valid_from").alias("since"), shown("valid_to").alias("until"))


@query(EDITS + """, m AS (SELECT date_trunc('minute', min(ts) + (max(ts) - min(ts)) / 2) AS mid FROM events), a AS (SELECT k, v FROM i, m WHERE v IS NOT NULL AND tm <= mid AND (until IS NULL OR until > mid)) SELECT p_partkey, coalesce(v, p_name) AS name FROM part LEFT JOIN a ON p_partkey = k""")
def edited_parts(t, spark):
    """Parts under the names that hold half way through the log."""
    ends = t("events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()  # two times
    mid = F.date_trunc("minute", F.lit(ends.a + (ends.b - ends.a) / 2))
    return CH.overridden(t("part"), "p_partkey", CH.as_of(edits(t), mid), "name", c("p_name")).select("p_partkey", "name")


# Timetable grids: orders as papers; schools by priority, sessions by status, found in the data.

PAPERS = """WITH s AS (SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN o_custkey % 2 = 0 THEN '10:00 AM' ELSE '02:00 PM' END AS time, CAST((1 + o_custkey % 3) * 3600 AS BIGINT) AS secs, o_orderpriority AS school, o_orderstatus AS session, 'Paper ' || (o_custkey % 9) AS subject, CAST(year(o_orderdate) AS VARCHAR) AS year, CAST(count(*) AS BIGINT) AS students FROM orders GROUP BY ALL),
p AS (SELECT *, school || ' / ' || session AS col, subject || ' (' || year || ' | ' || students || ')' AS item FROM s) """
SCHOOLS = [f"{a} / {b}" for a in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW") for b in "FOP"]


def papers(t) -> DataFrame:
    keys = [c("o_orderdate").cast("date").alias("day"), F.when(c("o_custkey") % 2 == 0, "10:00 AM").otherwise("02:00 PM").alias("time"), ((1 + c("o_custkey") % 3) * 3600).cast("long").alias("secs"), c("o_orderpriority").alias("school"), c("o_orderstatus").alias("session"), F.concat(F.lit("Paper "), c("o_custkey") % 9).alias("subject"), F.year("o_orderdate").cast("string").alias("year")]
    return t("orders").groupBy(*keys).agg(F.count("*").alias("students"))


TEXTS = ", ".join(f"""coalesce(string_agg(item, ' / ' ORDER BY secs DESC, subject) FILTER (col = '{x}'), '--') AS "{x}" """ for x in SCHOOLS)
SUMS = ", ".join(f"""CAST(coalesce(sum(students) FILTER (col = '{x}'), 0) AS BIGINT) AS "{x}" """ for x in SCHOOLS)


def columns_sql(t_sql: str) -> str:
    return PAPERS + f"SELECT day, time, {t_sql} FROM p GROUP BY day, time"


@query(columns_sql(TEXTS))
def timetable_grid(t, spark):
    """Papers by (day, time) and found (school, session)."""
    return with_all(TT.grids(papers(t))[1], "--")


@query(columns_sql(SUMS + ", CAST(sum(students) AS BIGINT) AS total"))
def analysis_grid(t, spark):
    """Students by (day, time) and found (school, session), with totals."""
    return with_all(TT.grids(papers(t))[2], 0)


def with_all(grid: DataFrame, empty) -> DataFrame:
    """Columns that small tables may not have, for one schema at every size."""
    return grid.withColumns({x: F.lit(empty) if isinstance(empty, str) else F.lit(empty).cast("long") for x in SCHOOLS if x not in grid.columns})


def _workbook_sql() -> str:
    cells = lambda xs: " || chr(31) || ".join(f'CAST("{x}" AS VARCHAR)' for x in xs)
    grid = lambda sql, name: f"""SELECT '{name}' AS sheet, {cells(['day', 'time', *SCHOOLS, *(['total'] if name == 'Analysis' else [])])} AS line FROM ({sql})"""
    plan = PAPERS + f"SELECT 'Schedule' AS sheet, {cells(['day', 'time', 'school', 'session', 'subject', 'year', 'students'])} AS line FROM p"
    return f"SELECT * FROM ({plan}) UNION ALL {grid(columns_sql(TEXTS), 'Timetable')} UNION ALL {grid(columns_sql(SUMS + ', CAST(sum(students) AS BIGINT) AS total'), 'Analysis')}"


@query(_workbook_sql())
def timetable_workbook(t, spark):
    """K7: schedule, timetable and analysis written as one workbook by executors, and read back."""
    folder = local(spark)
    TT.timetable_workbook(folder, papers(t))
    rows = sheetreader.read(spark, f"{folder}/Timetable.xlsx", every_sheet=True, blank="").rows.where("_row_no > 0")
    return rows.select("sheet", F.array_join("cells", "\x1f").alias("line"))


# Widths of spans: a cell a part, over one to four columns; widths are declared by runs of columns, one a nation.


@query("""WITH w AS (SELECT n_nationkey * 2 AS a, n_nationkey * 2 + n_nationkey % 2 AS b, 5.0 + n_regionkey AS width FROM nation), s AS (SELECT p_partkey, p_size AS col, p_partkey % 4 AS across FROM part)
SELECT p_partkey, CAST(coalesce(sum((least(col + across, b) - greatest(col, a) + 1) * width) FILTER (least(col + across, b) >= greatest(col, a)), 0) AS DOUBLE) AS width FROM s, w GROUP BY p_partkey""")
def span_widths(t, spark):
    """Width of every span, by sums over runs of columns."""
    runs = t("nation").select(F.lit(0).alias("doc"), (c("n_nationkey") * 2).cast("int").alias("start"), (c("n_nationkey") * 2 + c("n_nationkey") % 2).cast("int").alias("end"), (c("n_regionkey") + 5.0).alias("width"))
    spans = t("part").select(F.lit(0).alias("doc"), "p_partkey", c("p_size").cast("int").alias("column"), (c("p_partkey") % 4).cast("int").alias("merge_across"))
    return spreadsheetml.widths(spans, runs, ["doc"]).select("p_partkey", "width")
