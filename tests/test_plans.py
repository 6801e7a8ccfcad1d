"""Pipelines and sources on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from markbook.plans import convocation, gazette, gracing, gradesheet, letters, merge, osm, questionwise, ranklist, student_master, timetable
from markbook.sources import documents, xlsx


def frame(spark, columns, data):
    names = columns.split("|")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], ", ".join(["_row_no int", *(f"`{n}` string" for n in names)]))
    return df.select(*(f"`{n}`" for n in names), "_row_no")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_xlsx_round_trip(spark, tmp_path):
    data = [["Roll  No", "Name"], ["1234567890123456", "A & <B>"], [None, "x"], ["3", None]]
    (tmp_path / "a.xlsx").write_bytes(xlsx.to_workbook({"One": data, "Two": [["z"], ["1"]]}))
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    paths = [str(tmp_path / "a.xlsx"), str(tmp_path / "bad.xlsx")]
    raw = xlsx.raw(spark, paths, sheet="*")
    got = xlsx.sheets(raw)
    assert list(got) == [("a.xlsx", "One"), ("a.xlsx", "Two")]
    assert rows(got["a.xlsx", "One"].select("Roll No", "Name")) == [("1234567890123456", "A & <B>"), ("3", None), (None, "x")]
    assert xlsx.unreadable(raw, paths) == [paths[1]]
    assert xlsx.raw(spark, paths[:1], blank="empty").where("_row_no = 3").first().cells == ["3", ""]


def test_workbooks_of_one_name_and_odd_paths(spark, tmp_path):
    for i, folder in enumerate(["a,b", "c"]):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "r.xlsx").write_bytes(xlsx.to_workbook({"S": [["x"], [str(i)]]}))
    (tmp_path / "empty.xlsx").write_bytes(xlsx.to_workbook({"S": []}))
    paths = [str(tmp_path / "a,b" / "r.xlsx"), str(tmp_path / "c" / "r.xlsx"), str(tmp_path / "empty.xlsx")]
    raw = xlsx.raw(spark, paths)
    got = xlsx.sheets(raw)
    assert [got[k, "S"].first().x for k in ("r.xlsx", "r.xlsx_2")] == ["0", "1"]
    assert xlsx.unreadable(raw, paths) == [] and got["empty.xlsx", "S"].count() == 0


def test_spreadsheet_xml(spark, tmp_path):
    ns = 'xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"'
    body = '<Row><Cell ss:MergeAcross="1"><Data>a</Data></Cell><Cell ss:Index="4"><Data>b</Data></Cell><Cell><Data>c</Data></Cell></Row><Row><Cell><Data>Result Declaration Date</Data></Cell></Row>'
    (tmp_path / "t.xml").write_text(f'<Workbook {ns}><Worksheet><Table><Column ss:Index="2" ss:Span="1" ss:Width="30.5"/>{body}</Table></Worksheet></Workbook>')
    cells = documents.spreadsheet_xml(spark, str(tmp_path / "t.xml"))
    assert rows(cells) == [(0, 0, "a", 1, 0), (0, 3, "b", 0, 0), (0, 4, "c", 0, 0), (1, 0, "Result Declaration Date", 0, 0)]
    assert rows(documents.column_widths(spark, str(tmp_path / "t.xml"))) == [(1, 30.5), (2, 30.5)]
    found = gazette.xml_blocks(cells, "a | b")
    assert [r.text for r in found.orderBy("row").collect()] == ["a | b | c", "Result Declaration Date"]


def test_holidays(spark):
    good, bad = documents.holidays(spark, "14/1/2026\n2026-01-26\n\nsoon")
    assert good.count() == 2 and rows(bad) == [("soon",)]


def test_merge_and_audit(spark):
    a = spark.createDataFrame([("1", "x", "9"), ("2", "y", "8"), ("1", "x", "9"), (None, None, None)], "`Roll No` string, Name string, M string")
    b = spark.createDataFrame([("1.0", "x")], "`roll  no` string, name string")
    got = merge.merge({"a": a, "b": b}, ["Roll No", "Name"])
    assert got.columns == ["Roll No", "Name", "M", "Source File", "is_duplicate"] and got.count() == 4
    assert [r["Duplicate Group"] for r in merge.duplicate_report(got, ["Roll No", "Name"]).collect()] == ["Roll No:1 | Name:x"] * 3
    assert merge.without_duplicates(got, ["Roll No", "Name"], ["Source File", "M"], "last").count() == 2


def test_rank_list(spark):
    df = frame(spark, "Student No|Student Name|Program Name|CGPA|Rank", [(str(i), "n", "B.Com", "9", f"Rank {i}") for i in range(1, 31)] + [("x", "n", "M.Com", "9", None)])
    got = ranklist.rank_list(df)
    assert sorted(r.clean_rank for r in got.where("in_top").collect()) == [1, 2]
    assert got.where("is_first").count() == 1


def test_student_master(spark):
    df = frame(spark, "Student Number|Program Name|Academic Sess|Final Status|Gender|Religion", [("1", "B", "1", "Pass", "M", ""), ("1", "B", "2", "Fail", "M", "x"), ("2", "B", "1", "Pass", None, "x")])
    got = student_master.student_master(df)
    assert got["kpi"].first()[:] == (2, 1, 1, 50.0)
    assert rows(got["by_session"]) == [("Semester 1", 2), ("Semester 2", 1)]
    assert not student_master.worth_showing(got["religion"])


def test_convocation(spark):
    cols = "Student Number|Student Name|Gender|Final Grade|CGPA|Highest month of passing|Convocation Number|Student RE|PRN|SEM 1_GPA|SEM 5_GPA|SEM 6_GPA"
    report = frame(spark, cols, [("1.0", "Ram", "Male", "Grade A", "8", "March,2026", "", "", "p", "8", "8", "8"), ("2", "Sita", "F", "A", "8", "m", "77", "", "p", "8", "8", "8"), ("3", "Om", "M", "A", "8", "m", "", "", "p", "", "8", "8"), ("9", "No", "M", "A", "7", "m", "", "", "p", "1", "1", "1")])
    master = frame(spark, "Student Number|Program Name|APAAR ID", [("1", "", "x"), ("1", "Bachelor of Commerce", "a1"), ("2", "B.A.", "a2"), ("3", "B.A.", "a3")])
    got = convocation.convocation(report, master, {"COLL_NO": "7"})
    assert got.columns == convocation.TARGET and len(got.columns) == 35
    first = got.where("SEAT_NO = '1'").first()
    assert (first.FACULTY, first.SEX, first.CLASS, first.MMONTH, first.COLL_NO, first["APAAR ID"], first.SUBDEGNM) == ("Commerce & Management", "1", "'A' Grade", "March २०२६", "7", "a1", "Three Year Degree Course")
    assert sorted(r.SEAT_NO for r in got.collect()) == ["1", "9"]
    assert rows(convocation.exceptions(report, master)) == [("9", "No")]
    assert ("TOTAL", 2, 0, 2) in rows(convocation.statistics(got))
    assert convocation.eligible(report.drop("CGPA"), master).count() == 0


def test_gracing(spark):
    cols = "Student Number|Student Name|Additional ID|Gender|Module Code|Module Desc|Credit|Appraisal Type Code|Marks before Gracing|Marks after Gracing|Scale|Appraisal Remarks|General Remarks|Completion Status after Gracing"
    mk = lambda s, m, t, a, sc: (s, "n" + s, "", "M", m, "d" + m, "4", t, "", a, sc, "", "", "Completed Unsuccessfuly " if s == "1" else "ok")
    df = frame(spark, cols, [mk("1", "X", "Internal Actual", "20", "R050"), mk("1", "X", "Sem Actual", "18", "R050"), mk("1", "X", "Sem Grace", "2", "R050"), mk("1", "X", "Composite Score", "40", "R100"), mk("2", "X", "Internal Actual", "Z1", "R050"), mk("2", "X", "Sem Actual", "30", "R050"), mk("2", "X", "Composite Score", "99", "R100"), ("1", "TOTAL", "", "", "", "", "", "", "", "", "", "", "", "")])
    assert rows(gracing.failed_students(df)) == [("1",)]
    cases = gracing.graced_cases(df)
    assert [(r["Student Number"], r.grace, r.actual, r.composite) for r in cases.collect()] == [("1", 2.0, "18", "40")]
    assert gracing.student_summary(cases).first()["items"] == "dX (+2)"
    assert gracing.subject_summary(cases).first().mean == 2.0
    out = gracing.processed(df).collect()
    assert [(r["Student Number"], r.kind) for r in out] == [(s, k) for s in "12" for k in ("HEADER", "DATA", "SUMMARY")]
    one, two = out[1], out[4]
    assert (one.red_internal, one.red_sem, one.red_grace, one.red_composite) == (False, True, True, False)
    assert (two.internal, two.red_internal, two.red_composite) == ("AB", True, True)
    assert gracing.processed(df, gracing.failed_students(df)).count() == 3


def test_dashboard(spark):
    cols = "CategoryName|CourseName|Semester/Trimester|RoleName|ExaminerName|Mobile|AbsentCount|PresentCount|CheckCount|InprogressCount|RejectCount|UnCheckCount|UploadCount|ExamDate|AssignedDateTime|EvaluationLastDate|OldEvaluationLastDate"
    df = frame(spark, cols, [("[Re-Exam] x", "c", "1", "r", "e", None, "1", "10", "5", "0", "0", "5", "10", "1/2/2024", "5/2/2024", "3/2/2024", "-"), ("x", "c", "1", "r", "e", "9", "0", "0", "3", "0", "1", "0", "0", "bad", "1/2/2024", "3/2/2024", "1/1/2024"), ("Count: 12", *[None] * 16)]).drop("_row_no")
    got = osm.load({"dir/Alpha Beta Evaluation Dashboard Details 1.xlsx": df})
    assert got.count() == 2
    assert sorted((r.Exam_Type, r.Extended, r.window_days, r.College) for r in got.collect()) == [("Re-Exam", "No", None, "AB"), ("Regular", "Yes", 2, "AB")]
    k = osm.kpis(got, "2024-02-10").first()
    assert (k.PresentCount, k.CheckCount, k.progress_pct, k.overdue, k.has_rejections) == (10, 8, 80.0, 1, True)
    assert osm.by(got, ["ExaminerName", "Mobile"]).count() == 1 and osm.by(got, ["ExaminerName", "Mobile"], drop_null_keys=False).count() == 2
    assert osm.filtered(got, {"CourseName": "All"}, ("2024-01-01", "2024-12-31")).count() == 1
    assert osm.pending(got, "2024-02-03").first().state == "today" and osm.completed(got, "x").count() == 1


def test_questionwise(spark):
    cols = "SrNo|Subject Name-Subject code|PRNNumber|UserType|MarkAttendance|TotalObtainedScore|Q1 (10)|Q2 (40)"
    mk = lambda p, u, t, q1: ("1", "Law-BC1", p, u, "Present", t, q1, "5")
    df = frame(spark, cols, [mk("1", "Examiner", "30", "5"), mk("1", "Moderator", "36", "8"), mk("2", "Examiner", "20", "5"), mk("3", "Examiner", "AB", ""), mk("3", "Reval 1", "10", "2"), ("Count: 5", None, "7", None, None, None, None, None), mk("x", "Examiner", "1", "1")])
    clean = questionwise.clean(df)
    assert [r.PRNNumber for r in clean.collect()] == ["1", "1", "2", "3", "3"]
    changed = questionwise.with_change(clean)
    assert [r["Change %"] for r in changed.collect() if r["Change %"] is not None] == [12.0]
    assert questionwise.ten_percent_rule(changed).first().eligible
    assert questionwise.change_summary(clean).first()[:] == (1, 0, 0)
    register = frame(spark, "Student Number|Modulecode|AGR type|Grades|MAX Marks", [("1", "BC1", "Internal Total", "+ 20", ""), ("1", "BC1", "Internal Total", "+ 22", ""), ("1", "BC1", "Composite x", "", "100")])
    full = questionwise.with_register(clean, register).where("PRNNumber = '1' and UserType = 'Moderator'").first()
    assert (full["Internal Marks"], full["Total Marks Obtained"], full.Grade) == ("+ 22", 58.0, "B")
    assert questionwise.for_download(clean).count() == 3 and questionwise.reviewed(clean).count() == 4
    assert {r.PRNNumber for r in questionwise.changed(clean).collect()} == {"1"}
    assert ("1", "Moderator", "Q1 (10)", 5.0, 8.0, "up") in rows(questionwise.question_changes(clean))


def test_timetable(spark):
    cols = "School Name|Program Name|Program Abbreviation|Current Academic Year|Current Session|Module Description|Module Abbreviation|Credit|Student Number|Exam Duration"
    mk = lambda sub, st: ("S", "P", "p", "2024", "1", sub, "m", "4", st, "2:00")
    df = frame(spark, cols, [mk("A", "1"), mk("B", "1"), mk("B", "2"), mk("C", "2"), mk("C", "3"), mk("A", "3"), mk("D", "4"), mk("A", "4"), mk("Law", "8"), mk("Laws", "9")])
    days = timetable.working_days(spark, "2026-01-03", 6)
    got = timetable.schedule(df, days, "10:00 AM", threshold=0.8)
    by = {r.subject: r for r in got.collect()}
    assert len({by[s].day for s in "ABC"}) == 3 and by["D"].day != by["A"].day
    assert by["Law"].node == by["Laws"].node and by["Law"].is_common
    assert by["A"].time == "10:00 AM - 12:00 PM" and all(r.day.weekday() != 6 for r in by.values())
    assert timetable.analysis_grid(got, ["S"]).agg(F.sum("total")).first()[0] == 10
    assert timetable.timetable_grid(got, ["S"]).count() >= 3
    apps = frame(spark, "Prog. Code|Prog. Name|Module code|Module name|Student number|Acad. Year|Acad. Session|GR Applicable|Appraisal Description", [("p", "P", "m", "A", "1", "AY 2024-25", "1", "yes", "Sem Actual"), ("q", "P", "m", "A", "2", "2024", "1", "YES", "SEM ACTUAL"), ("p", "P", "m", "A", "3", "2024", "1", "no", "SEM ACTUAL")])
    report = frame(spark, "School Name|Program Abbreviation|Current Academic Year|Current Session|Module Abbreviation|Credit|Is GR Applicable?|Exam Mode|Exam Duration", [("S", "p", "2024.0", "1", "M", "4", "Y", "WRIT", "2:00"), ("T", "p", "2024", "1", "m", "4", "Y", "WRIT", "3:00")])
    assert [(r.student, r.school, r.incomplete) for r in timetable.reexam(apps, report).orderBy("student").collect()] == [("1", "S", "No"), ("2", None, "Yes")]


def test_grade_sheets(spark):
    from test_functions import PAGE

    found = gradesheet.profiles(spark.createDataFrame([("d", 1, PAGE), ("d", 2, "")], "doc string, page int, text string"))
    assert [r.status for r in found.orderBy("page").collect()] == ["OK", "No student"]
    assert gradesheet.long_subjects(found).count() == 2 and gradesheet.widest(found) == 2
    assert gradesheet.wide_subjects(found, 2).where("page = 1").first()["Sub2 code"] == "BCOM102"
    assert gradesheet.figures(found)["counts"].first()[:] == (2, 1, 1, 50.0)


BLOCK = ["Module Credits", "1 12345678901 A1 /ASHA 123456789012", "BCOM101 BCOM102 BCOM103", "IA 20 | 15 | 18 |", "TH 50 | 20 | 40 |", "Total 70 A 9 4 | 35 F00 | 58 B$ 7 4 | 163/300 54.33%", "36 | -- | 28 |", "[Semester I C-8 SGPA-5.3] [Remark: Unsuccessful]", "2 22345678901 A2 RAM Result in abeyance"]


def test_gazette(spark):
    lines = spark.createDataFrame([("d", 3, i, t) for i, t in enumerate(BLOCK, 1)], "doc string, page int, line_no int, text string")
    found = gazette.students(lines)
    a, b = found.orderBy("block").collect()
    assert (a.sap_no, a.gender, a.result, a.marks.obtained, a.percentage) == ("12345678901", "Female", "Unsuccessful", "163", 54.33)
    assert (b.result, b.subjects) == ("Result in abeyance", [])
    subs = gazette.subject_rows(found, spark.createDataFrame([("BCOM101", "Accounts")], "code string, title string"))
    got = {r.code: r for r in subs.collect()}
    assert (got["BCOM101"].title, got["BCOM101"].internal, got["BCOM101"].marks, got["BCOM101"].credit_points) == ("Accounts", "20", "70", 36.0)
    assert (got["BCOM102"].title, got["BCOM102"].fill, got["BCOM103"].fill) == ("BCOM102", "fail", "carried")
    cat = gazette.catalogue(spark.createDataFrame([("BCOM101 Accounts and Law 4 25 75 100",), ("x",)], "text string"))
    assert rows(cat) == [("BCOM101", "Accounts and Law", "4", "25", "75", "100")]


def test_letters(spark):
    df = frame(spark, "RoleName|ExaminerName|ExaminerEmail|CourseName", [("Examiner", "A", "", "x"), ("examiner ", "A", "e", "y"), ("Moderator", "B", "e", "z")])
    got = letters.letter_records(df, "examiner", "2026", "2025-26").orderBy("assignment").collect()
    assert [(r.name, r.email, r.assignment) for r in got] == [("A", "-", 1), ("A", "e", 2)]


@pytest.mark.parametrize("n", [0, 3])
def test_empty_inputs(spark, n):
    df = frame(spark, "Student No|Student Name|Program Name|CGPA|Rank", [("1", "n", "B", "9", "1")] * n)
    assert ranklist.rank_list(df).count() == n


def test_streaming_extra(spark, tmp_path):
    from conftest import SF
    from markbook.streaming.completion import windowed_completion

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_completion(stream, "ts", ["event_type"], F.col("value") > 10, "1 day").writeStream.outputMode("complete").format("memory").queryName("done").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(total) from done").first()[0] == events.count()


def test_gracing_gathers_a_module_once(spark):
    """Rows of modules are gathered by one aggregate, without joins of their own; a module without a code isn't shown."""
    from markbook.plans import gracing as GR

    names = ["Student Number", "Student Name", "Additional ID", "Gender", "Module Code", "Module Desc", "Credit", GR.TYPE, GR.BEFORE, GR.AFTER, "Scale", "General Remarks", "Completion Status after Gracing"]
    line = lambda code, kind, after, n: ("1", "n", None, "F", code, "d", "4", kind, "", after, "R050", "r", "Completed", n)
    rows = [line("M", GR.ACTUAL, "31", 2), line("M", GR.ACTUAL, "30", 1), line("M", GR.GRADE, "P", 3), line(None, GR.ACTUAL, "9", 4)]
    got = GR.processed(spark.createDataFrame(rows, ", ".join(f"`{x}` string" for x in names) + ", _row_no long"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert [(r.kind, r.actual, r.grade, r.remarks) for r in got.collect()] == [("HEADER", None, None, None), ("DATA", "30", "P", "r"), ("SUMMARY", None, None, None)]


def test_gracing_reads_the_sheet_once_for_its_students(spark):
    """head, data and sums come from one written table of modules, so the sheet isn't gathered again for each; marks of ungraced modules aren't combined."""
    from markbook.plans import gracing as GR

    names = ["Student Number", "Student Name", "Additional ID", "Gender", "Module Code", "Module Desc", "Credit", GR.TYPE, GR.BEFORE, GR.AFTER, "Scale", "General Remarks", "Completion Status after Gracing"]
    line = lambda s, name, code, desc, kind, after, n: (s, name, None, "F", code, desc, "4", kind, "", after, "R050", "r", "\tCompleted Unsuccessfuly", n)
    rows = [
        line("1", "first", None, "d", GR.ACTUAL, "9", 1), line("1", "later", "M", "d", GR.ACTUAL, "30", 2), line("1", "later", "M", "d", GR.GRACE, "2", 3), line("1", " total\t", "M", "d", GR.GRACE, "9", 4), line("1", "x", "M", " ", GR.GRACE, "9", 5),
        line("2", "Totalis", "N", "e", GR.ACTUAL, "8", 6), line("3", "only", None, "e", GR.ACTUAL, "8", 7),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"`{x}` string" for x in names) + ", _row_no long")
    got = GR.processed(df, GR.failed_students(df), ordered=False)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 0 and "Sort " not in plan
    assert sorted((r["Student Number"], r.kind, r.label, r.actual, r.grace) for r in got.collect()) == [
        ("1", "DATA", "M - d", "30", 2.0), ("1", "HEADER", "1 | first | F", None, None), ("1", "SUMMARY", "\tCompleted Unsuccessfuly", None, None), ("2", "DATA", "N - e", "8", None), ("2", "HEADER", "2 | Totalis | F", None, None), ("2", "SUMMARY", "\tCompleted Unsuccessfuly", None, None), ("3", "HEADER", "3 | only | F", None, None),
    ]
    cases = GR.graced_cases(df)
    assert [(r["Student Number"], r["Module Code"], r.grace, r.actual) for r in cases.collect()] == [("1", "M", 2.0, "30")]
    assert "LeftSemi" in cases._jdf.queryExecution().optimizedPlan().toString()
