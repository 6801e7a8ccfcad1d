"""Queries over documents that are put together from the driver's tables: grade sheets, gazettes, exports with odd headers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.catalog import c, query
from markbook.functions import dates as D
from markbook.functions import extract as X
from markbook.functions import numbers as N
from markbook.functions import text as T
from markbook.operators import aggregates as A
from markbook.operators import graph as G
from markbook.operators import schema as C
from markbook.operators import sets as U
from markbook.plan_queries import export
from markbook.plans import gazette as GZ
from markbook.plans import gradesheet as GS

E = F.expr


# Grade sheets: a page a customer, with two subject lines, figures with letter spacing, and every tenth page unreadable.

PAGES = """WITH p AS (SELECT c_custkey AS k, c_name AS name, 'Prog ' || c_mktsegment AS programme, c_custkey % 60 + 10 AS first, c_custkey % 80 AS second, c_custkey % 10 = 9 AS torn FROM customer),
s AS (SELECT k, torn, 'BCOM101' AS code, 'Accounts I' AS title, '4.00' AS credits, CAST(first AS VARCHAR) AS total, CASE WHEN first < 20 THEN 'F' ELSE 'O' END AS grade, 'Yes' AS marked FROM p WHERE NOT torn
 UNION ALL SELECT k, torn, 'LAW20A', 'Law', '2.50', CAST(second AS VARCHAR), CASE WHEN second < 30 THEN 'F' ELSE 'A+' END, 'No' FROM p WHERE NOT torn AND k % 4 <> 1) """


def sheets(t) -> DataFrame:
    lines = [
        "concat('Name of the Student : ', if(c_custkey % 2 = 0, '/', ''), c_name)", "concat('Student No. / Roll No. : ', 70000000 + c_custkey, ' / A', c_custkey)", "concat('Uni. PRN / Reg. No. : 2024', c_custkey)", "concat('Programme : Prog ', c_mktsegment)",
        "'Academic Year : 2024-2025'", "concat('BCOM101 Accounts I 4.00 25 20 75 50$ ', c_custkey % 60 + 10, ' ', if(c_custkey % 60 < 10, 'F', 'O'))", "if(c_custkey % 4 = 1, 'no subject here', concat('LAW20A Law 2.50 25 -- 75 25 ', c_custkey % 80, ' ', if(c_custkey % 80 < 30, 'F', 'A+')))",
        "concat('AGGREGATE MARKS : ', c_custkey % 90 + 10, ' / 2 0 0 PERCENTAGE : 5 ', c_custkey % 10, ' . 5 0 SGPA : ', c_custkey % 9 + 1, '.10')", "concat('REMARK : ', if(c_custkey % 5 = 0, 'UNSUCCESSFUL', 'SUCCESSFUL$'))",
    ]
    page = F.when(c("c_custkey") % 10 == 9, "").otherwise(F.concat_ws("\n", *(E(x) for x in lines)))
    return GS.profiles(t("customer").select(F.lit("d").alias("doc"), c("c_custkey").alias("page"), page.alias("text")))


@query(PAGES + """SELECT k AS page, CASE WHEN torn THEN '' ELSE CAST(70000000 + k AS VARCHAR) END AS sap_no, CASE WHEN torn THEN '' ELSE 'A' || k END AS roll_no, CASE WHEN torn THEN '' ELSE name END AS name, CASE WHEN torn THEN '' WHEN k % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender, CASE WHEN torn THEN '' ELSE '2024' || k END AS prn,
 CASE WHEN torn THEN '' ELSE programme END AS programme, CASE WHEN torn THEN '' ELSE CAST(k % 90 + 10 AS VARCHAR) END AS marks, CASE WHEN torn THEN '' ELSE '200' END AS max_marks, CASE WHEN torn THEN '' ELSE '5' || (k % 10) || '.50' END AS percentage, CASE WHEN torn THEN '' ELSE (k % 9 + 1) || '.10' END AS sgpa, CASE WHEN torn THEN '' WHEN k % 5 = 0 THEN 'UNSUCCESSFUL' ELSE 'SUCCESSFUL' END AS remark,
 CASE WHEN torn OR k % 5 = 0 THEN 'No' ELSE 'Yes' END AS remark_marked, CASE WHEN torn THEN 'No student' ELSE 'OK' END AS status FROM p""")
def gradesheet_profiles(t, spark):
    """G10, Y1, Y2, Y3, Y7, Y8, X21."""
    return sheets(t).select("page", "sap_no", "roll_no", "name", "gender", "prn", "programme", "marks", "max_marks", "percentage", "sgpa", "remark", "remark_marked", "status")


@query(PAGES + "SELECT k AS page, code, title, credits, total, grade, marked, grade = 'F' AS failed FROM s")
def gradesheet_subjects(t, spark):
    """G10, M1, Y5, F33, R5."""
    return GS.long_subjects(sheets(t)).select("page", "code", "title", "credits", "total", "grade", "marked", "failed")


@query(PAGES + """SELECT a.k AS page, a.code AS first_code, a.grade AS first_grade, b.code AS second_code, b.total AS second_total FROM p LEFT JOIN s a ON a.k = p.k AND a.code = 'BCOM101' LEFT JOIN s b ON b.k = p.k AND b.code = 'LAW20A' WHERE NOT p.torn""")
def gradesheet_wide(t, spark):
    """G10, M1, K5."""
    found = sheets(t)
    wide = GS.wide_subjects(found, GS.widest(found)).where("`Sub1 code` is not null and `Sub1 code` <> ''")
    return wide.select("page", c("Sub1 code").alias("first_code"), c("Sub1 grade").alias("first_grade"), F.nullif("Sub2 code", F.lit("")).alias("second_code"), F.nullif("Sub2 total", F.lit("")).alias("second_total"))


@query(PAGES + """SELECT CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (NOT torn AND k % 5 <> 0) AS BIGINT) AS successful, CAST(count(*) FILTER (torn) AS BIGINT) AS to_review, round(100.0 * count(*) FILTER (NOT torn AND k % 5 <> 0) / count(*), 1) AS success_pct, round(avg(CASE WHEN NOT torn THEN k % 9 + 1.1 END), 2) AS mean, max(CASE WHEN NOT torn THEN CAST(k % 9 + 1.1 AS DOUBLE) END) AS largest FROM p""")
def gradesheet_figures(t, spark):
    """G10, A12, A23."""
    got = GS.figures(sheets(t))
    return got["counts"].crossJoin(got["sgpa"])  # one row each


@query(PAGES + "SELECT 'grade' AS field, grade AS value, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY ALL UNION ALL SELECT 'remark', CASE WHEN k % 5 = 0 THEN 'UNSUCCESSFUL' ELSE 'SUCCESSFUL' END, count(*) FROM p WHERE NOT torn GROUP BY ALL")
def gradesheet_frequencies(t, spark):
    """G10, A7."""
    got = GS.figures(sheets(t))
    return got["grades"].select(F.lit("grade").alias("field"), "value", "n").union(got["remarks"].select(F.lit("remark").alias("field"), "value", "n"))


@query("""SELECT p_partkey, 'C' || chr(CAST(65 + p_size % 26 AS INT)) || '101' AS code, CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS total, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'O' END AS grade, CASE WHEN p_size % 3 <> 0 AND p_size % 2 = 0 THEN 'Yes' ELSE 'No' END AS marked FROM part""")
def grid_subjects(t, spark):
    """Rows of a table grid, short ones padded."""
    code = E("concat('C', chr(cast(65 + p_size % 26 as int)), '101')")
    full = F.array(code, F.lit(" Law "), F.lit("4"), F.lit("25"), F.lit("20"), F.lit("75"), F.lit("50"), E("concat(p_size, if(p_size % 2 = 0, '$', ''))"), F.lit("0"))
    grid = F.array(F.array(F.lit("Code"), F.lit("Title")), F.when(c("p_size") % 3 == 0, F.array(code, F.lit("Law"))).otherwise(full))
    rows = t("part").select("p_partkey", F.explode(X.subjects_from_grid(grid)).alias("s"))
    return rows.select("p_partkey", "s.code", "s.total", "s.grade", "s.marked")


@query("""SELECT p_partkey, 'II' AS semester, CAST(p_size AS VARCHAR) AS credits, p_size % 10 || '.5' AS sgpa FROM part""")
def semester_history(t, spark):
    """Y6, M6."""
    history = X.semester_history(F.array(F.lit("SEMESTER I"), F.lit("Sem II "), F.lit(" ")), F.array(F.lit("20"), E("concat(substr(cast(p_size as string), 1, 1), ' ', substr(cast(p_size as string), 2))"), F.lit("9")), F.array(F.lit("7"), E("concat(p_size % 10, ' . 5')"), F.lit("9")))
    return t("part").select("p_partkey", F.explode(history).alias("semester", "v")).where("semester = 'II'").select("p_partkey", "semester", "v.credits", "v.sgpa")


# Gazettes: a block of lines a customer on page 3, course lines on page 2.

BLOCKS = """WITH b AS (SELECT c_custkey AS k, 10000000000 + c_custkey AS sap, c_custkey % 7 = 0 AS held, c_custkey % 60 AS m1, c_custkey % 5 = 0 AS f2, c_custkey % 2 = 0 AS woman FROM customer),
j AS (SELECT k, sap, CASE WHEN f2 THEN 'Unsuccessful' ELSE 'Successful' END AS result, unnest([1, 2, 3]) AS i, m1, f2 FROM b WHERE NOT held) """


def gazette_lines(t) -> DataFrame:
    lines = [
        "concat('1 ', 10000000000 + c_custkey, ' A', c_custkey, ' MU2024X ', if(c_custkey % 2 = 0, '/', ''), 'RAM', if(c_custkey % 3 = 0, ' ~', ''), ' ', 100000000000 + c_custkey, if(c_custkey % 7 = 0, ' Result in abeyance', ''))",
        "'BCOM101 BCOM102 BCOM103'", "'----------'", "concat('IA ', c_custkey % 25, ' | 15 | 18 |')", "'TH 50 | 20 | 40 |'", "concat('Total ', c_custkey % 60, ' A 9 4 | ', if(c_custkey % 5 = 0, '35 F00', '45+ B+ 74'), ' | 58 B$ 7 4 | 163/300 ', if(c_custkey % 4 = 0, '54.33%', ''))",
        "'36 | -- | 28 |'", "concat('[Semester I C-8 CG-60 SGPA-', c_custkey % 10, '.3 F(2)] [Semester II-9] [Total Credit: 20 CGPA: 7.5 Final Grade: A+] [Remark: ', if(c_custkey % 5 = 0, 'Unsuccessful', 'Successful'), '; Eligible for next semester] Grade: B')", "'CONTROLLER OF EXAMINATIONS'",
    ]
    rows = t("customer").select("c_custkey", F.posexplode(F.array(*(E(x) for x in lines))).alias("line_no", "text"))
    body = rows.select(c("c_custkey").alias("doc"), F.lit(3).alias("page"), "line_no", "text")
    cover = t("customer").select(c("c_custkey").alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("line_no"), F.lit("1 12345678901 is no student").alias("text"))
    return body.union(cover.withColumn("text", F.lit("a cover page with no result")))


@query(BLOCKS + """SELECT k AS doc, CAST(sap AS VARCHAR) AS sap_no, 'A' || k AS roll_no, 'MU2024X' AS prn, CASE WHEN woman THEN 'Female' ELSE 'Male' END AS gender, CAST(100000000000 + k AS VARCHAR) AS abc_id, k % 3 = 0 AS pwd, held AS abeyance, CASE WHEN held THEN 'Result in abeyance' WHEN f2 THEN 'Unsuccessful' ELSE 'Successful' END AS result,
 CASE WHEN held THEN '' ELSE 'B' END AS grade, CASE WHEN held THEN 'Result in abeyance' ELSE 'Eligible for next semester' END AS eligibility, '163' AS obtained, CAST(54.33 AS DOUBLE) AS percentage, '20' AS total_credit, '7.5' AS cgpa, 'A+' AS final_grade FROM b""")
def gazette_students(t, spark):
    """G11, F28, F29, N12, N15, W14, Y11, Y13, Y14, Y15."""
    found = GZ.students(gazette_lines(t))
    return found.select("doc", "sap_no", "roll_no", "prn", "gender", "abc_id", "pwd", "abeyance", "result", "grade", "eligibility", c("marks.obtained").alias("obtained"), "percentage", "total_credit", "cgpa", "final_grade")


@query(BLOCKS + """SELECT k AS doc, 'BCOM10' || i AS code, CASE i WHEN 1 THEN 'Accounts' ELSE 'BCOM10' || i END AS title, CASE i WHEN 1 THEN CAST(k % 25 AS VARCHAR) WHEN 2 THEN '15' ELSE '18' END AS internal, CASE i WHEN 1 THEN CAST(m1 AS VARCHAR) WHEN 2 THEN CASE WHEN f2 THEN '35' ELSE '45+' END ELSE '58' END AS marks,
 CASE i WHEN 1 THEN 'A' WHEN 2 THEN CASE WHEN f2 THEN 'F' ELSE 'B+' END ELSE 'B$' END AS grade, CASE i WHEN 1 THEN CAST(36 AS DOUBLE) WHEN 2 THEN CASE WHEN f2 THEN 0 ELSE 28 END ELSE 28 END AS credit_points, i = 2 AND f2 AS failed, f2 AS unsuccessful,
 CASE WHEN i = 2 THEN CASE WHEN f2 THEN 'fail' ELSE 'fresh' END WHEN i = 3 THEN 'carried' WHEN k % 3 = 0 THEN 'pwd' ELSE '' END AS fill FROM j""")
def gazette_subjects(t, spark):
    """G11, J5, K14, M1, M2, N14, R4, Y12."""
    titles = spark.range(1).selectExpr("'BCOM101' AS code", "'Accounts' AS title")
    return GZ.subject_rows(GZ.students(gazette_lines(t)), titles).select("doc", "code", "title", "internal", "marks", "grade", "credit_points", "failed", "unsuccessful", "fill")


@query(BLOCKS + """SELECT k AS doc, 'I' AS semester, '8' AS credits, '60' AS cg, k % 10 || '.3' AS sgpa, 'F(2)' AS fails FROM b UNION ALL SELECT k, 'II', '9', '', '', '' FROM b""")
def gazette_semesters(t, spark):
    """Y14."""
    rows = GZ.students(gazette_lines(t)).select("doc", F.explode("semesters").alias("s"))
    return rows.select("doc", "s.semester", "s.credits", "s.cg", "s.sgpa", "s.fails")


def _wide_sql() -> str:
    subject = {1: ("CAST(k % 25 AS VARCHAR)", "'50'", "CAST(m1 AS VARCHAR)", "'A'", "'9'", "'4'"), 2: ("'15'", "'20'", "CASE WHEN f2 THEN '35' ELSE '45+' END", "CASE WHEN f2 THEN 'F' ELSE 'B+' END", "CASE WHEN f2 THEN '0' ELSE '7' END", "CASE WHEN f2 THEN '0' ELSE '4' END"), 3: ("'18'", "'40'", "'58'", "'B$'", "'7'", "'4'")}
    cells = [f"""CASE WHEN NOT held THEN {v} END AS "BCOM10{i} {f}" """ for i, vs in subject.items() for f, v in zip(GZ.SUBJECT_SHOWN, vs)]
    semesters = {"I": ("'8'", "'60'", "k % 10 || '.3'"), "II": ("'9'", "''", "''")}
    cells += [f"""{v} AS "Sem {s} {f}" """ for s, vs in semesters.items() for f, v in zip(GZ.SEMESTER_SHOWN, vs)]
    return BLOCKS + f"""SELECT k AS doc, CAST(sap AS VARCHAR) AS sap_no, 'A' || k AS roll_no, 'MU2024X' AS prn, {', '.join(cells)}, '20' AS total_credit, '7.5' AS cgpa, 'A+' AS final_grade,
 CASE WHEN held THEN 'Result in abeyance' WHEN f2 THEN 'Unsuccessful' ELSE 'Successful' END AS result FROM b"""


@query(_wide_sql())
def gazette_wide(t, spark):
    """Students with all subjects and semesters found, side by side."""
    got = GZ.wide(GZ.students(gazette_lines(t)), ("sap_no", "roll_no", "prn"), ("total_credit", "cgpa", "final_grade", "result"))
    return got.drop("block")


@query("""SELECT p_partkey, '2X' || 'LAW' || p_size AS code, p_name AS title, CASE WHEN p_size % 2 = 0 THEN '2.5' ELSE '0' END AS credits, '25' AS internal, '75' AS theory, CAST(p_size AS VARCHAR) AS total FROM part WHERE p_size < 40""")
def gazette_catalogue(t, spark):
    """Y10."""
    line = E("if(p_size < 40, concat('2XLAW', p_size, ' ', p_name, ' ', if(p_size % 2 = 0, '2.5', '--'), ' 25 75 ', p_size, ' and more'), concat('Total ', p_size))")
    return t("part").select("p_partkey", X.catalogue(line).alias("c")).where("c is not null").select("p_partkey", "c.*")


# Headers.


@query("""SELECT CAST(c_custkey AS VARCHAR) AS student, c_name AS name, c_mktsegment AS programme, CAST(c_nationkey AS VARCHAR) AS semester, '9' AS grade, CAST(NULL AS VARCHAR) AS absent, c_custkey % 3 AS seat FROM customer""")
def bound_headers(t, spark):
    """Logical columns from headers as users write them; what must be there and isn't is named."""
    df = C.clean_names(export(t("customer"), **{" Student   No. ": "c_custkey", "NAME ": "c_name", "prog_name": "'first'", "Prog Name": "c_mktsegment", "Semester/Trimester (2024)": "c_nationkey", "Final  Grade": "'9'", "seat": "c_custkey % 3"}))
    found = C.bind(df, {"student": ("StudentNo",), "name": (), "programme": ("ProgName",), "absent": ("Nothing",)}, ("student",), fold="alnum", on_duplicate="last")
    try:
        C.bind(df, {"x": ("X",), "y": ("Y",)}, ("x", "y"))
        lost = []
    except C.MissingColumns as e:
        lost = e.names
    other = {"semester": C.find(df.columns, ("semester/trimester",), "words", prefix=True), "grade": C.find(df.columns, ("FinalGrade",), "nospace")}
    if lost != ["x", "y"] or None in other.values():
        raise AssertionError(lost)
    both = df.select("*", *(F.col(f"`{h}`").alias(f"__{k}") for k, h in other.items()))
    named = C.bind(both, {"student": ("StudentNo",), "name": (), "programme": ("ProgName",), "semester": ("__semester",), "grade": ("__grade",), "absent": ("Nothing",), "seat": ()}, fold="alnum", on_duplicate="last")
    return named.withColumn("seat", c("seat").cast("long")).select(*found.columns, "semester", "grade", "seat")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS a, CAST(s_nationkey AS VARCHAR) AS b, '' AS missing, 'x' AS fallback, CAST(30 AS DOUBLE) AS largest, 'Id,Name,Nation,Q1 (10),Q2 (20)' AS moved, 'Name,Q1 (10)' AS present FROM supplier""")
def shaped_headers(t, spark):
    """C4, C7, C11, C12, C13, C14, C15, C18, C19, C20."""
    df = export(t("supplier"), **{"Id": "s_suppkey", "Q1 (10)": "'1'", "Name": "s_name", "Empty": "' '", "Nation": "s_nationkey", "Q2 (20)": "'x'"})
    full = C.without_blank_columns(df)
    largest = C.header_maximum(C.metric_columns(full.columns, ("Id", "Name", "Nation")))
    moved, present = C.move_after(full, ["Name", "Nation"], "Id").columns, C.present(full, ["Name", "Gone", "Q1 (10)"]).columns
    hits = {"a": C.find_containing(full.columns, [["no", "such"], ["nam"]]), "fallback": C.find_containing(full.columns, [["zzz"]], fallback=4)}
    named = C.renamed(full, {"Id": "id", "Nation": "b", "Gone": "z", hits["a"]: "a", hits["fallback"]: "fallback"}).drop("Gone")
    return C.conform(named, ["id", "a", "b", "missing", "fallback"]).withColumns({"largest": F.lit(largest), "moved": F.lit(",".join(moved)), "present": F.lit(",".join(present))})


@query("""SELECT * FROM (VALUES (1, 'id'), (2, 'Sub1 code'), (3, 'Sub2 code'), (4, 'Sem_II_gpa'), (5, 'Sem_X_gpa'), (6, 'total'), (7, 'remark'), (8, 'other')) v(place, name)""")
def section_order(t, spark):
    """C17."""
    names = C.section_order(["other", "remark", "Sem_X_gpa", "Sub2 code", "total", "Sem_II_gpa", "id", "Sub1 code"], ["id"], ["total"], ["remark"])
    return spark.createDataFrame(list(enumerate(names, 1)), "place int, name string")


# Others.


@query("""SELECT 'nation' AS source, CAST((SELECT count(*) FROM nation) AS BIGINT) AS rows, CAST(3 AS BIGINT) AS columns, true AS is_master, 'n_nationkey, n_name, n_regionkey' AS headers UNION ALL SELECT 'region', CAST((SELECT count(*) FROM region) AS BIGINT), CAST(2 AS BIGINT), false, 'r_regionkey, r_name'""")
def source_audit(t, spark):
    """A21."""
    return spark.createDataFrame(A.source_audit({"region": t("region"), "nation": t("nation")}), "source string, rows long, columns long, is_master boolean, headers string").select("source", "rows", "columns", "is_master", "headers")


@query("""SELECT n_nationkey, 'University of ' || n_name AS name, CASE WHEN n_nationkey % 10 = 3 THEN 'THREE' WHEN n_nationkey % 10 = 5 THEN 'FIVE' ELSE substr('UN' || CASE WHEN n_nationkey > 9 THEN substr(CAST(n_nationkey AS VARCHAR), 1, 1) ELSE substr(CAST(n_nationkey AS VARCHAR), 1, 1) END, 1, 5) END AS short FROM nation""")
def institution_names(t, spark):
    """The first keyword found, else initials without stop words."""
    name = F.concat(F.lit("University of "), c("n_name"))
    known = [("THREE", "_(13|23|3)$"), ("FIVE", "_(5|15)$")]
    return t("nation").select("n_nationkey", name.alias("name"), T.abbreviation(F.replace(name, F.lit("NATION_"), F.lit("Nation _")), known).alias("short0")).select("n_nationkey", "name", c("short0").alias("short"))


@query("""SELECT p_partkey, p_name || ' | Semester ' || p_size AS line, replace(p_name, ' ', '_') || '_Semester_' || p_size || '.xlsx' AS file, CAST(p_size AS INT) AS scale, upper(p_name) = upper(p_type) AS same FROM part""")
def paper_texts(t, spark):
    """K18, N2, X3, X27."""
    size = c("p_size").cast("string")
    same = F.upper(T.strip(F.concat(F.lit(" "), c("p_name")))) == F.upper(T.strip(c("p_type")))
    line, file = T.paper_line(F.concat(c("p_name"), F.lit(" ")), size), T.file_name(c("p_name"), size)
    return t("part").select("p_partkey", line.alias("line"), file.alias("file"), N.scale_max(F.concat(F.lit("R0"), size)).alias("scale"), same.alias("same"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '10:00 am to 12:00 noon' ELSE lpad(CAST(10 + p_size % 2 AS VARCHAR), 2, '0') || ':30 am to 01:' || lpad(CAST(p_size AS VARCHAR), 2, '0') || ' pm' END AS shown FROM part""")
def timetable_times(t, spark):
    """D7."""
    text = F.when(c("p_size") % 2 == 0, "10:00 AM - 12:00 PM").otherwise(F.concat(F.lpad((10 + c("p_size") % 2).cast("string"), 2, "0"), F.lit(":30 AM - 01:"), F.lpad(c("p_size").cast("string"), 2, "0"), F.lit(" PM")))
    return t("part").select("p_partkey", D.timetable_time(text).alias("shown"))


@query("""SELECT c_mktsegment AS name, CAST(round(60.0 * n / sum(n) OVER (), 3) AS DOUBLE) AS width FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)""")
def column_widths(t, spark):
    """Widths by weight where no minimum binds; they add up to the whole."""
    n = {r.c_mktsegment: float(r["count"]) for r in t("customer").groupBy("c_mktsegment").count().orderBy("c_mktsegment").collect()}  # one row a column of a report
    got = G.waterfill(n, {k: 2.0 for k in n}, 60.0)
    return spark.createDataFrame([(k, round(v, 3)) for k, v in got.items()], "name string, width double")


@query("""SELECT n_name AS name, 'nation' AS source FROM nation UNION ALL SELECT r_name, 'region' FROM region""")
def stacked_sheets(t, spark):
    """Rows of several sheets, one below the other."""
    return U.union_all({"nation": t("nation").select(c("n_name").alias("name")), "region": t("region").select(c("r_name").alias("name"))}, source="source")


@query("""SELECT 'nation' AS sheet, CAST(n_nationkey AS VARCHAR) AS a, n_name AS b FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name FROM region""")
def workbook_round_trip(t, spark):
    """Two sheets written to one workbook and read back."""
    from markbook.session import own_folder
    from markbook.sources import xlsx

    folder = spark.conf.get("spark.checkpoint.dir", None) or own_folder(spark.sparkContext.master)
    path = f"{folder.rstrip('/').removeprefix('file:')}/{uuid.uuid4().hex}.xlsx"
    xlsx.write_workbook(path, {"nation": t("nation").select("n_nationkey", "n_name"), "region": t("region")})
    got = xlsx.sheets(xlsx.raw(spark, [path], sheet="*"))
    rows = {sheet: df.toDF("a", "b", *df.columns[2:]).select(F.lit(sheet).alias("sheet"), "a", "b") for (_, sheet), df in got.items()}
    return rows["nation"].unionByName(rows["region"])
