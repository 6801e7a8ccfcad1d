"""Queries that run whole plans: exports as users load them are made from the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.catalog import c, query
from markbook.plans import convocation as CV
from markbook.plans import gracing as GR
from markbook.plans import letters as LT
from markbook.plans import osm as OS
from markbook.plans import questionwise as QW
from markbook.plans import student_master as SM
from markbook.plans import timetable as TT

E = F.expr


def export(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Columns by name (``__`` stands for a space), as text; ``_row_no`` as a number."""
    made = {k.replace("__", " "): (E(v) if isinstance(v, str) else v) for k, v in columns.items()}
    return df.select(*(v.cast("long" if k == "_row_no" else "string").alias(k) for k, v in made.items()))


# Gracing sheets: a student an order, two modules each, a row an appraisal type.

SHEET = """WITH b AS (SELECT o_orderkey AS k, CAST(unnest([0, 1]) AS BIGINT) AS m, o_custkey FROM orders),
d AS (SELECT k, m, CAST(k AS VARCHAR) AS student, 'M' || ((o_custkey + m) % 40) AS module, 'Module ' || ((o_custkey + m) % 40) AS description, (k + m) % 50 AS q, (k + m) % 20 AS own, (k + m) % 11 = 0 AS absent, CASE WHEN (k + m) % 7 = 0 THEN 3 ELSE 0 END AS grace FROM b)"""


def gracing_sheet(t) -> DataFrame:
    rows = t("orders").select(c("o_orderkey").alias("k"), "o_custkey", F.explode(E("array(0L, 1L)")).alias("m"))
    rows = rows.selectExpr("k", "m", "(o_custkey + m) % 40 AS code", "(k + m) % 50 AS q", "(k + m) % 20 AS own", "(k + m) % 11 = 0 AS absent", "if((k + m) % 7 = 0, 3, 0) AS grace")
    kinds = [(GR.INTERNAL, "if(absent, 'Z1', cast(own as string))", "R020"), (GR.ACTUAL, "q", "R050"), (GR.GRACE, "grace", "R050"), (GR.SEMESTER, "q + 3", "R050"), (GR.COMPOSITE, "if(k % 4 = 0, q + 1, q + grace + if(absent, 0, own))", "R070"), (GR.GRADE, "if(q < 20, 'F', 'P')", "")]
    cells = [F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), E(f"cast({v} as string)").alias("after"), F.lit(scale).alias("scale")) for i, (kind, v, scale) in enumerate(kinds)]
    rows = rows.select("*", F.explode(F.array(*cells)).alias("x"))
    sheet = dict(Student__Number="k", Student__Name="concat('n', k)", Additional__ID="if(k % 2 = 0, 'NA', concat('a', k))", Gender="'M'", Module__Code="concat('M', code)", Module__Desc="concat('Module ', code)", Credit="4")
    sheet |= dict(Appraisal__Type__Code="x.kind", Marks__before__Gracing="''", Marks__after__Gracing="x.after", Scale="x.scale", General__Remarks="''", Completion__Status__after__Gracing="if(k % 3 = 0, 'Completed Unsuccessfuly ', 'Completed')", _row_no="(k * 2 + m) * 10 + x.i")
    total = sheet | dict(Student__Name="'Total '", Marks__after__Gracing="'5'", _row_no="(k * 2 + m) * 10 + 8")
    blank = sheet | dict(Module__Desc="' '", Marks__after__Gracing="'6'", _row_no="(k * 2 + m) * 10 + 9")
    grace = rows.where(c("x.kind") == GR.GRACE)
    return export(rows, **sheet).union(export(grace.where("k % 10 = 0"), **total)).union(export(grace.where("k % 10 = 1"), **blank))


CASES = SHEET + ", g AS (SELECT * FROM d WHERE grace > 0) "


@query(CASES + "SELECT student, module, description, CAST(grace AS DOUBLE) AS grace, CAST(q AS VARCHAR) AS actual, CAST(q + 3 AS VARCHAR) AS semester, CAST(CASE WHEN k % 4 = 0 THEN q + 1 ELSE q + grace + CASE WHEN absent THEN 0 ELSE own END END AS VARCHAR) AS composite, CASE WHEN q < 20 THEN 'F' ELSE 'P' END AS grade FROM g")
def gracing_cases(t, spark):
    """G6, F18, F19, J6."""
    return GR.graced_cases(gracing_sheet(t)).select(c("Student Number").alias("student"), c("Module Code").alias("module"), c("Module Desc").alias("description"), "grace", "actual", "semester", "composite", "grade")


@query(CASES + "SELECT module, description, CAST(count(DISTINCT student) AS BIGINT) AS n_entities, sum(CAST(grace AS DOUBLE)) AS total, CAST(max(grace) AS DOUBLE) AS largest, round(avg(grace), 2) AS mean FROM g GROUP BY ALL")
def gracing_by_subject(t, spark):
    """G6, A9."""
    return GR.subject_summary(GR.graced_cases(gracing_sheet(t))).withColumnsRenamed({"Module Code": "module", "Module Desc": "description"})


@query(CASES + "SELECT student, CAST(count(*) AS BIGINT) AS n, string_agg(description || ' (+' || grace || ')', ', ' ORDER BY m) AS items, sum(CAST(grace AS DOUBLE)) AS total FROM g GROUP BY student")
def gracing_by_student(t, spark):
    """G6, A10."""
    return GR.student_summary(GR.graced_cases(gracing_sheet(t))).withColumnRenamed("Student Number", "student")


@query(SHEET + "SELECT DISTINCT student FROM d WHERE k % 3 = 0")
def gracing_failed(t, spark):
    """F20."""
    return GR.failed_students(gracing_sheet(t)).withColumnRenamed("Student Number", "student")


@query(SHEET + """, f AS (SELECT *, CASE WHEN k % 4 = 0 THEN q + 1 ELSE q + grace + CASE WHEN absent THEN 0 ELSE own END END AS whole, CASE WHEN absent THEN 0 ELSE own END + q + grace AS parts FROM d WHERE k % 3 = 0)
SELECT student, 'HEADER' AS kind, student || ' | n' || student || CASE WHEN k % 2 = 0 THEN '' ELSE ' | a' || student END || ' | M' AS label, CAST(NULL AS DOUBLE) AS credit, CAST(NULL AS VARCHAR) AS internal, CAST(NULL AS VARCHAR) AS actual, CAST(NULL AS DOUBLE) AS grace, CAST(NULL AS VARCHAR) AS composite, CAST(NULL AS VARCHAR) AS grade, CAST(NULL AS BOOLEAN) AS red_internal, CAST(NULL AS BOOLEAN) AS red_sem, CAST(NULL AS BOOLEAN) AS red_grace, CAST(NULL AS BOOLEAN) AS red_composite, CAST(NULL AS DOUBLE) AS points FROM f WHERE m = 0
UNION ALL SELECT student, 'DATA', module || ' - ' || description, 4.0, CASE WHEN absent THEN 'AB' ELSE CAST(own AS VARCHAR) END, CAST(q AS VARCHAR), CAST(grace AS DOUBLE), CAST(whole AS VARCHAR), CASE WHEN q < 20 THEN 'F' ELSE 'P' END, absent OR own < 8, q < 20, grace > 0, abs(parts - whole) >= 0.01, CAST(whole AS DOUBLE) FROM f
UNION ALL SELECT student, 'SUMMARY', 'Completed Unsuccessfuly ', 8.0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, sum(CAST(whole AS DOUBLE)) FROM f GROUP BY student""")
def gracing_processed(t, spark):
    """Restructured sheet of the students who failed."""
    sheet = gracing_sheet(t)
    return GR.processed(sheet, GR.failed_students(sheet)).withColumnRenamed("Student Number", "student").drop("seq", "remarks")


# Marking dashboard: an export a status of orders.

COLLEGES = [("ALPHA", "ALPHA"), ("BETA", "BETA|SECOND")]
OSM = """WITH o AS (SELECT *, o_orderkey AS k, o_orderkey % 30 AS present, CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE (o_orderkey % 30) // 2 END AS checked, o_orderkey % 4 AS absent, o_orderkey % 3 AS rejected,
 CAST(o_orderdate AS DATE) AS exam, CAST(o_orderdate AS DATE) + 3 AS assigned, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 AS INT) AS deadline FROM orders),
r AS (SELECT k, present, checked, absent, rejected, present - checked AS unchecked, CASE WHEN k % 23 = 0 THEN NULL ELSE exam END AS exam, assigned, deadline, CASE WHEN deadline >= assigned THEN deadline - assigned END AS window_days,
 CASE WHEN k % 6 = 0 THEN 'Yes' ELSE 'No' END AS extended, CASE o_orderstatus WHEN 'F' THEN 'ALPHA' WHEN 'O' THEN 'BETA' ELSE 'PGT' END AS college, CASE WHEN k % 5 = 0 THEN 'Re-Exam' ELSE 'Regular' END AS exam_type, CASE WHEN k % 9 = 0 THEN NULL ELSE o_orderpriority END AS role FROM o) """
FILES = {"F": "in/Alpha College Evaluation Dashboard Details 1.xlsx", "O": "Second Campus - Evaluation Dashboard Details.xlsx", "P": "Patel Girls Training_evaluation dashboard details (3).xlsx"}
DAY = "date_format(date_add(o_orderdate, cast({} as int)), 'd/M/yyyy')"


def dashboard(t) -> DataFrame:
    checked = "if(o_orderkey % 17 = 0, 0, (o_orderkey % 30) div 2)"
    columns = dict(
        CategoryName="if(o_orderkey % 5 = 0, '[RE-EXAM] x', 'x')", CourseName="concat('c', o_orderkey)", **{"Semester/Trimester": "'1'"}, RoleName="if(o_orderkey % 9 = 0, null, o_orderpriority)", AbsentCount="o_orderkey % 4", PresentCount="concat(' ', o_orderkey % 30, '.0')",
        CheckCount=f"if(o_orderkey % 17 = 0, 'none', cast({checked} as string))", InprogressCount="''", RejectCount="o_orderkey % 3", UnCheckCount=f"(o_orderkey % 30) - {checked}", UploadCount="0",
        ExamDate=f"if(o_orderkey % 23 = 0, '31/31/2024', {DAY.format(0)})", AssignedDateTime=DAY.format(3), EvaluationLastDate=DAY.format("o_orderkey % 20"), OldEvaluationLastDate="if(o_orderkey % 6 = 0, '1/1/1990', '-')",
    )
    footer = {k: "cast(null as string)" for k in columns} | {"CategoryName": "'Count: 12'"}
    frames = {}
    for status, name in FILES.items():
        own = t("orders").where(c("o_orderstatus") == status)
        frames[name] = export(own, **columns).union(export(t("region"), **footer)).union(export(t("region"), **{k: "' '" for k in columns}))
    return OS.load(frames, COLLEGES)


@query(OSM + "SELECT 'c' || k AS course, college, exam_type, CAST(window_days AS INT) AS window_days, extended, strftime(deadline, '%d/%m/%Y') AS deadline FROM r")
def dashboard_rows(t, spark):
    """G7, D1, D2, X14, X15, X16, X17, J17, U3, F1, F2, F3."""
    return dashboard(t).select(c("CourseName").alias("course"), c("College").alias("college"), c("Exam_Type").alias("exam_type"), "window_days", c("Extended").alias("extended"), c("deadline_shown").alias("deadline"))


@query(OSM + """SELECT CAST(sum(absent) AS BIGINT) AS absent, CAST(sum(present) AS BIGINT) AS present, CAST(sum(checked) AS BIGINT) AS checked, CAST(sum(rejected) AS BIGINT) AS rejected, CAST(sum(unchecked) AS BIGINT) AS unchecked, CAST(count(*) FILTER (unchecked > 0 AND deadline < DATE '1998-01-01') AS BIGINT) AS overdue,
 round(100.0 * sum(checked) / sum(present), 1) AS progress_pct, round(100.0 * sum(present) / (sum(present) + sum(absent)), 1) AS attendance_pct, sum(rejected) > 0 AS has_rejections FROM r""")
def dashboard_kpis(t, spark):
    """G7, A2, A3, F12, R9, K15, N1."""
    names = {"AbsentCount": "absent", "PresentCount": "present", "CheckCount": "checked", "RejectCount": "rejected", "UnCheckCount": "unchecked"}
    return OS.kpis(dashboard(t), "1998-01-01").drop("InprogressCount", "UploadCount").withColumnsRenamed(names)


@query(OSM + "SELECT role, exam_type, CAST(sum(present) AS BIGINT) AS present, CAST(sum(checked) AS BIGINT) AS checked, round(100.0 * sum(checked) / nullif(sum(present), 0), 1) AS completion_pct FROM r WHERE college = 'ALPHA' AND exam BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND role IS NOT NULL GROUP BY ALL ORDER BY present DESC, role, exam_type LIMIT 6")
def dashboard_by_role(t, spark):
    """G7, A1, F7, F9, T1, K16."""
    rows = OS.filtered(dashboard(t), {"College": "ALPHA", "Exam_Type": "All"}, ("1996-01-01", "1997-12-31"))
    got = OS.by(rows, ["RoleName", "Exam_Type"], top=6)
    return got.select(c("RoleName").alias("role"), c("Exam_Type").alias("exam_type"), c("PresentCount").alias("present"), c("CheckCount").alias("checked"), "completion_pct")


@query(OSM + "SELECT 'c' || k AS course, CASE WHEN deadline < DATE '1998-01-01' THEN 'overdue' WHEN deadline = DATE '1998-01-01' THEN 'today' WHEN deadline = DATE '1998-01-02' THEN 'tomorrow' ELSE 'none' END AS state FROM r WHERE unchecked > 0")
def dashboard_pending(t, spark):
    """G7, F11, T3, D3, R7, K8."""
    return OS.pending(dashboard(t), "1998-01-01").select(c("CourseName").alias("course"), "state")


@query(OSM + "SELECT 'late' AS list, 'c' || k AS course FROM r WHERE unchecked > 0 AND deadline < DATE '1997-06-01' UNION ALL SELECT 'rejected', 'c' || k FROM r WHERE rejected > 0 UNION ALL SELECT 'completed', 'c' || k FROM r WHERE unchecked = 0 AND contains('c' || k, '7')")
def dashboard_lists(t, spark):
    """G7, F11, F12, F13, K8."""
    rows = dashboard(t)
    lists = {"late": OS.late_rows(rows, "1997-06-01"), "rejected": OS.rejected(rows), "completed": OS.completed(rows.select("CourseName", "UnCheckCount").withColumn("UnCheckCount", F.when(c("UnCheckCount") == 0, 0).otherwise(1)), "7")}
    out = None
    for name, df in lists.items():
        one = df.select(F.lit(name).alias("list"), c("CourseName").alias("course"))
        out = one if out is None else out.union(one)
    return out


@query(OSM + "SELECT 'window_days' AS field, CAST(window_days AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n FROM r WHERE window_days IS NOT NULL GROUP BY ALL UNION ALL SELECT 'extended', extended, count(*) FROM r GROUP BY ALL")
def dashboard_deadlines(t, spark):
    """G7, A7, T11, K16."""
    out = None
    for name, df in OS.deadline_profile(dashboard(t)).items():
        one = df.select(F.lit(name).alias("field"), "value", "n")
        out = one if out is None else out.union(one)
    return out


# Question-wise check: a paper an order; moderators and revaluers of some.

CHECK = """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 40 AS s, CAST(o_orderkey % 7 - 3 AS BIGINT) AS d FROM orders),
e AS (SELECT k, 'Examiner' AS kind, 1 AS reviewer, CASE WHEN k % 13 = 0 THEN 'AB' ELSE CAST(s AS VARCHAR) END AS score, s AS n, CAST(s % 10 AS DOUBLE) AS q1 FROM o
 UNION ALL SELECT k, 'Moderator', 2, CAST(s + d AS VARCHAR), s + d, CAST((s + d) % 10 AS DOUBLE) FROM o WHERE k % 3 = 0
 UNION ALL SELECT k, 'Reval 1', 3, CAST(s AS VARCHAR), s, CAST(s % 10 AS DOUBLE) FROM o WHERE k % 5 = 0) """


def papers(t) -> DataFrame:
    rows = t("orders").selectExpr("o_orderkey AS k", "o_orderkey % 40 AS s", "o_orderkey % 7 - 3 AS d")
    paper = lambda i, kind, score, q1: dict(SrNo="k", **{"Subject Name-Subject code": "'Law-BC1'", "PRNNumber": "concat(' ', k, '.0')", "UserType": f"'{kind}'", "MarkAttendance": "if(k % 26 = 0, 'UFM', 'Present')", "TotalObtainedScore": score, "Q1 (10)": q1, "Q2 (40)": "'5'"}, _row_no=f"k * 10 + {i}")
    out = export(rows, **paper(0, "Examiner", "if(k % 13 = 0, 'AB', cast(s as string))", "s % 10"))
    out = out.union(export(rows.where("k % 3 = 0"), **paper(1, "moderator ", "s + d", "(s + d) % 10"))).union(export(rows.where("k % 5 = 0"), **paper(2, "Reval 1", "s", "s % 10")))
    junk = {k: "cast(null as string)" for k in paper(0, "", "", "") if k != "_row_no"}
    lines = [junk, junk | {"SrNo": "'Count: 9'", "PRNNumber": "'7'"}, junk | {"SrNo": "'1'", "PRNNumber": "'x7'"}, junk | {"SrNo": "'1'", "UserType": "'Examiner'"}]
    for i, one in enumerate(lines):
        out = out.union(export(t("region"), **one, _row_no=f"-{i} - 1"))
    return QW.clean(out)


def _student(df: DataFrame) -> DataFrame:
    return df.withColumn("student", c("PRNNumber").cast("long"))


@query(CHECK + "SELECT k AS student, reviewer, score FROM e")
def questionwise_rows(t, spark):
    """G8, F1, F4, F5, F6, T4, M5, X1."""
    return _student(papers(t)).select("student", "reviewer", c("TotalObtainedScore").alias("score"))


@query(CHECK + "SELECT DISTINCT e.k AS student, 'reviewed' AS list FROM e WHERE reviewer > 1 UNION ALL SELECT DISTINCT e.k, 'changed' FROM e JOIN e AS b ON e.k = b.k AND b.reviewer = 1 AND b.score <> 'AB' WHERE e.reviewer > 1 AND e.n <> b.n")
def questionwise_students(t, spark):
    """G8, F25, F26, J7, J10."""
    rows = papers(t)
    a, b = _student(QW.reviewed(rows)).select("student", F.lit("reviewed").alias("list")), _student(QW.changed(rows)).select("student", F.lit("changed").alias("list"))
    return a.union(b).distinct()


@query(CHECK + "SELECT k AS student, round(CAST(d AS DOUBLE) / 50.0 * 100.0, 2) AS change FROM o WHERE k % 3 = 0 AND k % 13 <> 0")
def questionwise_change(t, spark):
    """G8, C11, N9, W16."""
    return _student(QW.with_change(papers(t))).where("`Change %` is not null").select("student", c("Change %").alias("change"))


@query(CHECK + "SELECT CAST(count(*) FILTER (d > 0) AS BIGINT) AS up, CAST(count(*) FILTER (d < 0) AS BIGINT) AS down, CAST(count(*) FILTER (d = 0) AS BIGINT) AS same FROM o WHERE k % 3 = 0 AND k % 13 <> 0")
def questionwise_change_counts(t, spark):
    """G8, A17."""
    return QW.change_summary(papers(t))


@query(CHECK + """SELECT k AS student, CASE WHEN kind = 'Moderator' THEN 'moderator' ELSE 'examiner' END AS kind, CASE WHEN score = 'AB' THEN CASE WHEN k % 26 = 0 THEN 'UFM' ELSE 'ABSENT' END ELSE score END AS label FROM e WHERE reviewer = 2 OR (reviewer = 1 AND k % 3 <> 0)""")
def questionwise_download(t, spark):
    """G8, F23, F35, J9, X20."""
    return _student(QW.for_download(papers(t))).select("student", F.lower(F.trim("UserType")).alias("kind"), c("TotalObtainedScore").alias("label"))


@query(CHECK + """SELECT e.k AS student, e.reviewer, b.q1 AS examiner, e.q1 AS mark, CASE WHEN e.q1 > b.q1 THEN 'up' WHEN e.q1 < b.q1 THEN 'down' ELSE 'same' END AS direction FROM e JOIN e AS b ON e.k = b.k AND b.reviewer = 1 WHERE e.reviewer > 1""")
def questionwise_question_marks(t, spark):
    """G8, R2, N16."""
    rows = _student(QW.question_changes(papers(t))).where("question = 'Q1 (10)'")
    return rows.select("student", F.when(F.lower(F.trim("UserType")) == "moderator", 2).otherwise(3).alias("reviewer"), "examiner", "mark", "direction")


@query(CHECK + """SELECT e.k AS student, e.reviewer, '+ ' || (e.k % 9 + 1) AS internal, CASE WHEN reviewer = 2 OR (reviewer = 1 AND k % 3 <> 0) THEN CAST(e.k % 30 AS VARCHAR) ELSE '' END AS semester, CASE WHEN score = 'AB' THEN 0 ELSE n END + CAST(e.k % 9 + 1 AS DOUBLE) AS total,
 CASE WHEN p >= 90 THEN 'O' WHEN p >= 80 THEN 'A+' WHEN p >= 70 THEN 'A' WHEN p >= 60 THEN 'B+' WHEN p >= 55 THEN 'B' WHEN p >= 50 THEN 'C' WHEN p >= 40 THEN 'P' ELSE 'F' END AS grade FROM (SELECT *, (CASE WHEN score = 'AB' THEN 0 ELSE n END + k % 9 + 1) / 60.0 * 100.0 AS p FROM e) e""")
def questionwise_marks(t, spark):
    """G8, J1, J8, N8, N10, S6."""
    kinds = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), E(mark).cast("string").alias("mark"), F.lit(most).alias("most")) for i, (kind, mark, most) in enumerate([("Internal Total", "'99'", ""), ("Internal Total", "concat('+ ', o_orderkey % 9 + 1)", ""), ("Composite Score", "''", "60"), ("Semester Total Marks", "o_orderkey % 30", "50")]))))
    register = export(t("orders").select("o_orderkey", kinds.alias("x")), Student__Number="o_orderkey", Modulecode="'BC1'", AGR__type="x.kind", Grades="x.mark", MAX__Marks="x.most", _row_no="o_orderkey * 10 + x.i")
    got = _student(QW.with_register(papers(t), register))
    return got.select("student", "reviewer", c("Internal Marks").alias("internal"), c("Semester Marks").alias("semester"), c("Total Marks Obtained").alias("total"), c("Grade").alias("grade"))


# Convocation: a student a customer.

PROGRAMMES = {"AUTOMOBILE": "Bachelor of Commerce", "BUILDING": "Master of Science in Data", "FURNITURE": "B.A. Film", "HOUSEHOLD": "Master of Law", "MACHINERY": "B.Voc. Cookery"}
LIST = """WITH s AS (SELECT c_custkey AS k, c_name AS name, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Bachelor of Commerce' WHEN 'BUILDING' THEN 'Master of Science in Data' WHEN 'FURNITURE' THEN 'B.A. Film' WHEN 'HOUSEHOLD' THEN 'Master of Law' ELSE 'B.Voc. Cookery' END AS programme, c_mktsegment AS segment FROM customer),
r AS (SELECT *, k % 13 = 0 AS unknown, CASE k % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE 'X' END AS sex, segment IN ('BUILDING', 'HOUSEHOLD') AND k % 13 <> 0 AS master, k % 8 = 0 AS late, k % 10 <> 0 AS g3, k % 12 <> 0 AS g4, k % 9 <> 0 AS g5 FROM s WHERE k % 7 <> 0 AND k % 11 <> 0),
e AS (SELECT * FROM r WHERE CASE WHEN late AND master THEN g3 AND g4 WHEN late THEN g5 AND g3 = g4 ELSE g3 AND g4 AND g5 END) """


def report_and_master(t) -> tuple[DataFrame, DataFrame]:
    gpa = lambda n: f"if(c_custkey % {n} = 0, 'NaN', '8')"
    columns = {"Student Number": "concat(c_custkey, '.0')", "Student  Name": "c_name", "GENDER": "element_at(array('Male', 'f', 'X'), cast(c_custkey % 3 + 1 as int))", "Final Grade": "concat('Grade ', element_at(array('A', \"'B+'\"), cast(c_custkey % 2 + 1 as int)))", "CGPA": "if(c_custkey % 11 = 0, ' ', '8.5')"}
    columns |= {"Highest month of passing": "'March,2026'", "Convocation Number": "if(c_custkey % 7 = 0, '77', '')", "Student RE": "if(c_custkey % 8 = 0, 'Lateral Admission 2', '')", "PRN": "concat('p', c_custkey)", "SEM 1_GPA": "'8'", "SEM 3_GPA": gpa(10), "SEM 4_GPA": gpa(12), "SEM 5_GPA": gpa(9), "SEM 6_GPA": "'8'"}
    programme = F.create_map(*(F.lit(x) for kv in PROGRAMMES.items() for x in kv))[c("c_mktsegment")]
    known = t("customer").where("c_custkey % 13 <> 0").withColumn("programme", programme)
    blank = export(known, Student__Number="c_custkey", Programme__Name="''", APAAR__ID="'old'", _row_no="c_custkey * 2 + 1")
    return export(t("customer"), **columns), export(known, Student__Number="c_custkey", Programme__Name="programme", APAAR__ID="concat('a', c_custkey)", _row_no="c_custkey * 2").union(blank)


COLLEGE = {"COLL_NO": "7", "COLL_NAME": "College"}


@query(LIST + """SELECT CAST(k AS VARCHAR) AS seat, name, CASE WHEN unknown THEN '' ELSE programme END AS programme, CASE WHEN unknown THEN '' WHEN segment IN ('AUTOMOBILE') THEN 'Commerce & Management' WHEN segment = 'BUILDING' THEN 'Science & Technology' WHEN segment = 'FURNITURE' THEN 'Humanities' ELSE '' END AS faculty,
 CASE WHEN unknown THEN '' WHEN segment IN ('BUILDING', 'HOUSEHOLD') THEN 'Two Year Degree Course' ELSE 'Three Year Degree Course' END AS length, CASE WHEN unknown THEN '' ELSE 'a' || k END AS apaar, sex, CASE WHEN k % 2 = 0 THEN '''A'' Grade' ELSE '''B+'' Grade' END AS class, 'March 2026' AS month, '7' AS college, '' AS lot FROM e""")
def convocation_list(t, spark):
    """G4, K4, F15, F16, F17, J3, C4, C6, C19, C21, T7, X2, X8, X9, X10, X12, X26."""
    got = CV.convocation(*report_and_master(t), COLLEGE)
    names = {"SEAT_NO": "seat", "NAME": "name", "DEGNM": "programme", "FACULTY": "faculty", "SUBDEGNM": "length", "APAAR ID": "apaar", "SEX": "sex", "CLASS": "class", "MONTH": "month", "COLL_NO": "college", "LOTNO": "lot"}
    return got.select(*(c(f"`{k}`").alias(v) for k, v in names.items()))


@query("SELECT c_custkey || '.0' AS student, c_name AS name FROM customer WHERE c_custkey % 13 = 0")
def convocation_exceptions(t, spark):
    """G4, J4."""
    return CV.exceptions(*report_and_master(t))


@query(LIST + """, n AS (SELECT CASE WHEN unknown THEN '[UNMATCHED PROGRAM]' ELSE programme END AS programme, sex FROM e)
SELECT coalesce(programme, 'TOTAL') AS programme, CAST(count(*) FILTER (sex = '1') AS BIGINT) AS male, CAST(count(*) FILTER (sex = '2') AS BIGINT) AS female, CAST(count(*) AS BIGINT) AS total FROM n GROUP BY ROLLUP (programme)""")
def convocation_statistics(t, spark):
    """G4, K4, A8."""
    return CV.statistics(CV.convocation(*report_and_master(t), COLLEGE)).withColumnRenamed("DEGNM", "programme")


# Student master: a row a student and session.

MASTER = """WITH m AS (SELECT o_custkey AS k, year(o_orderdate) AS session, 'P' || (o_custkey % 6) AS programme, CASE WHEN o_orderstatus = 'F' THEN 'pass class' ELSE 'Fail' END AS status, o_orderkey FROM orders WHERE o_custkey % 5 <> 0),
l AS (SELECT k, programme, status, session FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY session DESC, programme, status) = 1) """


def master_rows(t) -> DataFrame:
    columns = {"PRN ": "if(o_custkey % 5 = 0, null, o_custkey)", "Program Name": "concat('P', o_custkey % 6)", "Academic Sess": "year(o_orderdate)", "Final Status": "if(o_orderstatus = 'F', 'pass class', 'Fail')", "Gender": "if(o_custkey % 2 = 0, 'M', 'F')", "Nationality": "' Indian '"}
    return export(t("orders"), **columns)


@query(MASTER + "SELECT CAST(count(*) AS BIGINT) AS students, CAST(count(DISTINCT programme) AS BIGINT) AS programmes, CAST(count(*) FILTER (status = 'pass class') AS BIGINT) AS passed, round(100.0 * count(*) FILTER (status = 'pass class') / count(*), 1) AS pass_pct FROM l")
def student_master_kpi(t, spark):
    """G2, A4, C2, W1."""
    return SM.student_master(master_rows(t))["kpi"]


@query(MASTER + "SELECT 'Semester ' || dense_rank() OVER (ORDER BY session) AS semester, programme, students FROM (SELECT session, programme, CAST(count(DISTINCT k) AS BIGINT) AS students FROM m GROUP BY ALL)")
def student_master_sessions(t, spark):
    """G2, A5, W8, J14."""
    return SM.student_master(master_rows(t))["by_session_programme"]


@query(MASTER + "SELECT 'programme' AS field, programme AS value, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY ALL UNION ALL SELECT 'gender', CASE WHEN k % 2 = 0 THEN 'M' ELSE 'F' END, count(*) FROM l GROUP BY ALL")
def student_master_demographics(t, spark):
    """Only demographics with more than one value are shown."""
    got, out = SM.student_master(master_rows(t)), None
    for name in ("programme", "gender", "nationality", "religion"):
        if SM.worth_showing(got[name]):
            one = got[name].select(F.lit(name).alias("field"), "value", "n")
            out = one if out is None else out.union(one)
    return out


# Timetable.


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS student, CASE WHEN o_custkey % 50 < 40 THEN 'S' || (o_custkey % 50) END AS school, CASE WHEN o_custkey % 50 < 40 THEN 'No' ELSE 'Yes' END AS incomplete, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0""")
def timetable_reexam(t, spark):
    """G9, F21, F34, J2, X3, X6, C5."""
    applications = export(t("orders"), **{"Prog. Code": "'p'", "Prog. Name": "'P'", "Module code": "concat('m', o_custkey % 50)", "Module name": "'A'", "Student number": "o_orderkey", "Acad. Year": "concat('AY ', year(o_orderdate), '-', year(o_orderdate) + 1)", "Acad. Session": "'1'"}, GR__Applicable="if(o_orderkey % 3 = 0, 'no', ' yes')", Appraisal__Description="if(o_orderkey % 4 = 0, 'CA', 'Sem Actual')", _row_no="o_orderkey")
    year = F.explode(F.sequence(F.lit(1990), F.lit(2005)))
    report = spark.range(45).select("id", year.alias("y"), F.explode(F.array(F.lit(0), F.lit(1))).alias("twin"))
    report = export(report, School__Name="if(twin = 0, concat('S', id), 'later')", Program__Abbreviation="' P'", Current__Academic__Year="concat(y, '.0')", Current__Session="'1'", Module__Abbreviation="concat('M', id)", Credit="'4'", **{"Is GR Applicable?": "'Y'", "Exam Mode": "if(id < 40, 'WRIT', 'ORAL')", "Exam Duration": "'2:00'"}, _row_no="id * 100 + twin")
    return TT.reexam(applications, report).select("student", "school", "incomplete", "year")


@query("""WITH e AS (SELECT DISTINCT c_custkey AS k, 'PAPER Q' || chr(CAST(65 + (c_nationkey * 2 + c_custkey % 2) % 12 AS INT)) AS canon FROM customer WHERE c_custkey % 4 <> 3)
SELECT canon AS subject, CAST(count(*) AS BIGINT) AS students, '02:00:00' AS duration, '10:00 AM - 12:00 PM' AS time, true AS dated FROM e GROUP BY canon""")
def timetable_papers(t, spark):
    """Every paper has a working day of its own among those its students sit."""
    enrolled = export(t("customer"), School__Name="'S'", Program__Name="'P'", Program__Abbreviation="'p'", Current__Academic__Year="'2024'", Current__Session="'1'", Module__Description="concat('Paper Q', chr(cast(65 + (c_nationkey * 2 + c_custkey % 2) % 12 as int)), ' in English II')", Module__Abbreviation="'m'", Credit="'4'", Student__Number="c_custkey", Exam__Duration="'2:00'", Student__NA="if(c_custkey % 4 = 3, 'ORAL', ' writ')")
    got = TT.schedule(enrolled, TT.working_days(spark, "2026-01-03", 12), "10:00 AM")
    return got.select(c("canon").alias("subject"), "students", c("duration_shown").alias("duration"), "time", c("day").isNotNull().alias("dated"))


# Letters.


@query("""SELECT s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN '-' ELSE 'm' || s_suppkey END AS email, s_suppkey AS k, CAST(1 AS INT) AS assignment, '2025-26' AS academic_year FROM supplier WHERE s_nationkey % 2 = 0""")
def letters(t, spark):
    """Records of examiners' letters."""
    rows = export(t("supplier"), RoleName="if(s_nationkey % 2 = 0, ' EXAMINER', 'Moderator')", ExaminerName="s_name", ExaminerEmail="if(s_suppkey % 3 = 0, ' ', concat('m', s_suppkey))", CourseName="s_suppkey", _row_no="s_suppkey")
    return LT.letter_records(rows, "examiner", "2026", "2025-26").select("name", "email", c("course").cast("long").alias("k"), "assignment", "academic_year")
