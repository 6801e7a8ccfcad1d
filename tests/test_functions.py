"""Scalar expressions on worked examples."""

import random
import re

import pytest
from pyspark.sql import functions as F

from markbook.functions import dates as D
from markbook.functions import extract as E
from markbook.functions import numbers as N
from markbook.functions import text as X


def value(spark, expr, arg, kind="string"):
    arg = float(arg) if kind == "double" and arg is not None else arg
    return spark.createDataFrame([(arg,)], f"a {kind}").select(expr(F.col("a")).alias("x")).first().x


@pytest.mark.parametrize(
    ("expr", "arg", "want"),
    [
        (X.clean_cell, " 123.0 ", "123"), (X.clean_cell, None, ""), (X.clean_cell, "1.05", "1.05"),
        (X.clean_key, " 123.0", "123"), (X.clean_key, "007.0", "7"), (X.clean_key, "007", "007"), (X.clean_key, "ab.c", "AB"), (X.clean_key, "1.5E3", "1500"), (X.clean_key, None, ""),
        (X.canonical_subject, "business law in English  II", "BUSINESS LAW"), (X.canonical_subject, "Maths I II", "MATHS"), (X.canonical_subject, None, ""),
        (X.short_year, "2024-2025", "24-25"), (X.short_year, "x", "x"), (X.first_year, "AY 2024-25", "2024"), (X.first_year, "none", "none"),
        (X.faculty, "Bachelor of Commerce", "Commerce & Management"), (X.faculty, "B.Sc. IT", "Science & Technology"), (X.faculty, "B.A. Film", "Humanities"), (X.faculty, None, ""),
        (X.course_length, "Masters of X", "Two Year Degree Course"), (X.course_length, "b.com", "Three Year Degree Course"),
        (X.gender_code, " Female", "2"), (X.gender_code, "x", "x"), (X.class_text, "Grade B+", "'B+' Grade"), (X.class_text, "", ""),
        (X.devanagari_digits, "March 2026", "March २०२६"), (X.extended, "-", "No"), (X.extended, "1/2/2024", "Yes"),
        (X.shown_number, "12.0", "12"), (X.shown_number, "12.50", "12.5"), (X.shown_number, "+5", "5"), (X.shown_number, "AB", "AB"),
        (X.sheet_name, "A[1]/B: Semester  II", "AB Sem II"), (X.degap, "7 1 . 1 7", "71.17"), (X.without_marks, "45$~#", "45"), (X.without_rules, "a ---- b  c", "a b c"),
        (X.month_text, "March,2026", "March 2026"), (X.month_text, "nan", ""), (X.initials, "Alpha Beta College of Gamma", "ABG"),
        (N.first_number, "Rank 12", 12), (N.first_number, "x", None), (N.scale_max, "R050", 50), (N.number, "1d", None), (N.number, " 1e3 ", 1000.0), (N.number, "", None),
        (D.seconds, "02:30:59", 9000), (D.seconds, "2", 7200), (D.seconds, "bad", 0), (D.seconds, None, 0), (D.timetable_time, "10:00 AM - 12:00 PM", "10:00 am to 12:00 noon"),
        (lambda c: X.before_marker(c, "Evaluation Dashboard Details"), "dir/My Inst- Evaluation Dashboard Details 1.xlsx", "My Inst"),
        (lambda c: X.batch_text(c, 3), "2024-2025", "2022 - 2025"), (lambda c: X.batch_text(c, 3), "x", ""),
        (lambda c: D.time_range(c, F.lit(7200)), "10:30 AM", "10:30 AM - 12:30 PM"),
        (lambda c: F.date_format(D.parsed(c), "yyyy-MM-dd"), "1/2/2024", "2024-02-01"), (lambda c: D.shown(D.parsed(c)), "31/02/2024", "-"),
    ],
)
def test_scalar(spark, expr, arg, want):
    assert value(spark, expr, arg) == want


def test_key_cleaning_is_idempotent(spark):
    for k in ("a.b", "12.0", " x ", "1.5E3", "00"):
        once = value(spark, X.clean_key, k)
        assert value(spark, X.clean_key, once) == once


def test_marks(spark):
    got = [tuple(value(spark, N.mark, m)) for m in ("Z1", "Z3", "", None, "45", "45.5", "B+")]
    assert got == [("AB", None, True), ("UFM", None, True), ("", None, False), ("", None, False), ("45", 45.0, False), ("45.5", 45.5, False), ("B+", None, False)]


def test_pass_rule_is_strict(spark):
    f = lambda v: value(spark, lambda c: N.failed(c, F.lit(50), F.lit(False)), v, "double")
    assert (f(20.0), f(19.99), f(None)) == (False, True, False)


@pytest.mark.parametrize(("pct", "want"), [(90, "O"), (89.99, "A+"), (70, "A"), (60, "B+"), (55, "B"), (50, "C"), (40, "P"), (39.9, "F"), (None, "")])
def test_ladder(spark, pct, want):
    assert value(spark, lambda c: N.grade(c, F.lit(100)), pct, "double") == want
    assert value(spark, lambda c: N.grade(c, F.lit(0)), pct, "double") == ""


def test_quota(spark):
    assert [value(spark, N.quota, n, "long") for n in (1, 9, 10, 30, 50)] == [1, 1, 1, 2, 3]


def test_transliteration(spark):
    assert [X.devanagari_word(w) for w in ("ram", "aasha", "kheer", "chhaya", "a")] == ["रम्", "आश", "खीर्", "छय", "अ"]
    assert value(spark, X.transliterate, "Ram 12") == "रम् 12"
    assert value(spark, X.transliterate, None) is None


def test_transliteration_of_whole_texts(spark):
    """Every word as the driver's spelling has it, whatever stands around its letters, in a plan without a lambda over words."""
    rng = random.Random(4)
    letters = [*"abcdefghijklmnopqrstuvwxyzKHXVAangghhc", "\u0915", "\u00c9", "1", "-", "'", " ", "  "]
    texts = ["ngh nghy kchh chhh aaai aaau X V -- \u0915 -a1- \u00c9", "-" * 20_000 + "b", ""] + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", X.transliterate(F.col("t")).alias("out"))
    for text, out in df.collect():
        words = [(w, re.sub("[^A-Za-z]", "", w)) for w in re.split(" +", text.strip())]
        assert out == " ".join(X.devanagari_word(x) if x else w for w, x in words)
    assert "lambda" not in df._jdf.queryExecution().toString()


PAGE = """Name of the Student : /ASHA K
Student No. / Roll No. : 12345678 / A012
Programme : B.Com
Academic Year : 2024-2025
BCOM101 Accounts I 4.00 25 20 75 50$ 70 A+
BCOM102 Law 4.00 25 10 75 25 35 P
AGGREGATE MARKS : 105 / 200 PERCENTAGE : 5 2 . 5 0 SGPA : 7.10
REMARK : SUCCESSFUL$"""


def test_grade_sheet(spark):
    df = spark.createDataFrame([(PAGE,), (None,)], "t string")
    rows = df.select(*(c.alias(k) for k, c in E.grade_sheet_header(F.col("t")).items()), E.subjects(F.col("t")).alias("s")).collect()
    r = rows[0]
    assert (r["name"], r.gender, r.sap_no, r.roll_no, r.programme, r.marks, r.max_marks, r.percentage, r.sgpa, r.remark, r.remark_marked) == ("ASHA K", "Female", "12345678", "A012", "B.Com", "105", "200", "52.50", "7.10", "SUCCESSFUL", "Yes")
    assert [(s.code, s.title, s.ese_marks, s.grade, s.marked) for s in r.s] == [("BCOM101", "Accounts I", "50", "A+", "Yes"), ("BCOM102", "Law", "25", "P", "No")]
    assert rows[1].s == [] and rows[1].gender == ""


def test_grid_rows_are_padded(spark):
    df = spark.createDataFrame([([["Code", "Title"], ["BCOM101", "Law", "4", "25", "20", "75", "50", "70", "0"], ["BCOM102", "X"]],)], "g array<array<string>>")
    s = df.select(E.subjects_from_grid(F.col("g")).alias("s")).first().s
    assert [(x.code, x.grade, x.credits) for x in s] == [("BCOM101", "O", "4"), ("BCOM102", "", "")]


@pytest.mark.parametrize(
    ("seg", "want"),
    [("70 A 9 4", ("70", "A", "9", "4")), ("35 F00", ("35", "F", "0", "0")), ("45 B+ 74", ("45", "B+", "7", "4")), ("60 0 9 4", ("60", "O", "9", "4")), ("--", ("--", "", "", "")), ("", ("", "", "", "")), ("50 A $ 8 4", ("50", "A$", "8", "4"))],
)
def test_total_segment(spark, seg, want):
    assert tuple(value(spark, E.total_segment, seg)) == want


def test_student_header(spark):
    h = value(spark, E.student_header, "12 12345678901 A012 MU2024 /ASHA K ~ 123456789012")
    assert (h.serial, h.sap_no, h.roll_no, h.prn, h.name, h.gender, h.abc_id, h.pwd, h.abeyance) == ("12", "12345678901", "A012", "MU2024", "/ASHA K ~", "Female", "123456789012", True, False)
    assert value(spark, E.student_header, "Total | 1") is None
    assert value(spark, E.student_header, "1 123456789 A1 RAM Result in abeyance").abeyance


def test_remark_line(spark):
    text = "[Semester I C-20 CG-180 SGPA-9.0 Attempt-1] [Semester IIC-18 F(2)] [Remark: Successful; Grade-B+] CGPA : 8.5 Final Grade : A+ Total Credit : 38 Eligible for next semester"
    s = value(spark, E.semester_metrics, text)
    assert [(x.semester, x.credits, x.sgpa, x.fails) for x in s] == [("I", "20", "9.0", ""), ("II", "18", "", "F(2)")]
    df = spark.createDataFrame([(text,)], "t string").select(*(c.alias(k) for k, c in E.final_metrics(F.col("t")).items())).first()
    assert (df.cgpa, df.final_grade, df.grade, df.total_credit, df.result, df.eligibility) == ("8.5", "A+", "B+", "38", "Successful", "Eligible for next semester")


def test_paper_texts(spark):
    df = spark.createDataFrame([("Law: Part/1", "II"), ("Law", None)], "a string, b string")
    got = df.select(X.paper_line(F.col("a"), F.col("b")).alias("l"), X.file_name(F.col("a"), F.col("b")).alias("f")).collect()
    assert [tuple(r) for r in got] == [("Law: Part/1 | Semester II", "Law_Part_1_Semester_II.xlsx"), ("Law", "Law.xlsx")]
