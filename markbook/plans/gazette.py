"""Result gazettes from page text, and gazette tables from SpreadsheetML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markbook.functions import extract as E
from markbook.functions.numbers import grade_points, number, percent_or, split_ratio
from markbook.operators import scan
from markbook.operators.filters import NOISE, content_lines
from markbook.operators.joins import lookup
from markbook.operators.reshape import exploded, once, zipped
from markbook.operators.schema import semester_rank
from markbook.operators.windows import blocks, segments, split_at

RESULT_PAGE = r"\d{9,14}\s+[A-Z0-9]+|\bTotal\s*\|"


def students(lines: DataFrame, phrases: Sequence[str] = NOISE) -> DataFrame:
    """One row a student's block: header fields, ``subjects``, metrics and flags. ``lines``: doc, page, line_no, text.

    Pages up to the second count only if they look like results (F29). Withheld results keep their status alone (Y15).
    """
    looks = F.max(F.when(F.col("text").rlike(RESULT_PAGE), 1).otherwise(0)).over(Window.partitionBy("doc", "page"))
    kept = content_lines(lines.withColumn("__looks", looks).where("page >= 3 or __looks = 1").drop("__looks"), "text", phrases)
    numbered = segments(kept, F.col("text").rlike(E.HEADER_LINE), ["page", "line_no"], ["doc"], "block")
    packed = numbered.groupBy("doc", "block").agg(F.sort_array(F.collect_list(F.struct("page", "line_no", "text"))).alias("l"))
    rows = packed.select("doc", "block", F.transform("l", lambda x: x["text"]).alias("lines"))
    rows = once(rows, {"h": E.student_header(F.col("lines")[0]), "body": F.slice("lines", F.lit(2), F.size("lines") - 1)}).where("h is not null")
    rows = once(rows, {**E.block_subjects(F.col("body")), "joined": F.array_join("body", " ")})
    rows = once(rows, {**E.final_metrics(F.col("joined")), "semesters": E.semester_metrics(F.col("joined")), "marks": split_ratio(F.col("grand_total"))}).drop("joined")
    lists = zipped({k: F.col(k) for k in ("codes", "internal", "theory", "totals", "points")})
    made = F.transform(lists, lambda s: F.struct(s["codes"].alias("code"), s["internal"].alias("internal"), s["theory"].alias("theory"), E.total_segment(s["totals"]).alias("t"), s["points"].alias("cg")))
    held = F.col("h.abeyance")
    return rows.select(
        "doc", "block", "h.*", F.when(held, F.array().cast(rows.select(made.alias("m")).schema["m"].dataType)).otherwise(made).alias("subjects"), "semesters", "marks", percent_or(F.col("percentage"), number(F.col("marks.obtained")), number(F.col("marks.largest"))).alias("percentage"), "total_credit", "total_cg", "cgpa", "final_grade",
        "cumulative_percentage", F.when(held, E.ABEYANCE).otherwise(F.col("result")).alias("result"), F.when(held, "").otherwise(F.col("grade")).alias("grade"), F.when(held, E.ABEYANCE).otherwise(F.col("eligibility")).alias("eligibility"),
    )


def subject_rows(found: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """A row a subject with its title (else its code), credit points and flags."""
    rows = exploded(found, ["doc", "block", "sap_no", "pwd", "result"], "subjects").where("code <> ''").select("*", "t.*").drop("t")
    rows = rows.withColumn("credit_points", grade_points(F.col("cg"), F.col("points"), F.col("credits")))
    if titles is not None:
        rows = lookup(rows, titles, ["code"], {"title": "title"}, ["title"], "last").withColumn("title", F.coalesce("title", "code"))
    fail, fresh, carried = F.col("grade").contains("F"), F.col("marks").contains("+"), F.concat("marks", "grade").contains("$")
    fill = F.when(fail, "fail").when(fresh, "fresh").when(carried, "carried").when(F.col("pwd"), "pwd").otherwise("")
    return rows.withColumns({"failed": fail, "unsuccessful": F.lower("result").startswith("unsuccessful"), "fill": fill})


SUBJECT_SHOWN = ("internal", "theory", "marks", "grade", "points", "credits")
SEMESTER_SHOWN = ("credits", "cg", "sgpa")


def found_names(found: DataFrame, most: int = 4096) -> tuple[list[str], list[str]]:
    """Subject codes, sorted, and semesters, in their order, of all students; more than ``most`` are refused."""
    both = found.select(F.explode(F.transform("subjects", lambda s: F.struct(F.lit("subject").alias("kind"), s["code"].alias("name")))).alias("x"))
    both = both.union(found.select(F.explode(F.transform("semesters", lambda s: F.struct(F.lit("semester").alias("kind"), s["semester"].alias("name"))))))
    names = both.select("x.*").where("name <> ''").distinct().limit(most + 1).collect()
    if len(names) > most:
        raise ValueError(f"a gazette has more than {most} subjects and semesters")
    return sorted(r.name for r in names if r.kind == "subject"), sorted((r.name for r in names if r.kind == "semester"), key=lambda x: (semester_rank(x), x))


def wide(found: DataFrame, ids: Sequence[str] = ("sap_no", "roll_no", "name", "prn"), totals: Sequence[str] = ("percentage", "total_credit", "cgpa", "final_grade", "result", "eligibility")) -> DataFrame:
    """A row a student: doc, block and ids, then what was found of every subject and semester, then totals.

    Names are found first by a combined aggregate; a student's lists become maps, read in one projection. Of a subject that a
    student has twice the last counts; what a student doesn't have is null.
    """
    codes, semesters = found_names(found)
    by = lambda lists, name: F.map_from_entries(F.transform(F.array_distinct(F.transform(lists, lambda s: s[name])), lambda k: F.struct(k, F.element_at(F.filter(lists, lambda s: s[name] == k), -1))))
    mapped = once(found, {"__s": by(F.col("subjects"), "code"), "__m": by(F.col("semesters"), "semester")})
    of_subject = lambda k, f: F.try_element_at("__s", F.lit(k))[f] if f in ("internal", "theory") else F.try_element_at("__s", F.lit(k))["t"][f]
    columns = [of_subject(k, f).alias(f"{k} {f}") for k in codes for f in SUBJECT_SHOWN]
    columns += [F.try_element_at("__m", F.lit(k))[f].alias(f"Sem {k} {f}") for k in semesters for f in SEMESTER_SHOWN]
    return mapped.select("doc", "block", *ids, *columns, *totals)


def catalogue(lines: DataFrame) -> DataFrame:
    """Courses of a gazette's second page."""
    return lines.select(E.catalogue(F.col("text")).alias("c")).where("c is not null").select("c.*")


def xml_blocks(cells: DataFrame, start: str, end: str = "Result Declaration Date", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, block, part, row, text) of the rows between markers, legend apart; cells of a row joined by `` | ``.

    ``keys`` name a document; without them all rows are one, in whatever length: its blocks are found by a prefix scan.
    """
    rows = cells.groupBy(*keys, "row").agg(F.sort_array(F.collect_list(F.struct("column", "text"))).alias("c")).withColumn("text", F.array_join(F.transform("c", lambda x: x["text"]), " | ")).drop("c")
    starts, ends, note = F.col("text").contains(start), F.col("text").contains(end), F.col("text").rlike(r"^\W*Note:")
    if keys:
        return split_at(blocks(rows, starts, ends, ["row"], list(keys)), note, ["row"], [*keys, "block"])
    found = scan.Ordered(scan.blocks(rows, starts, ends, ["row"]), ["block", "row"]).last("__note", F.when(note, F.col("block")))
    return found.column("part", F.when(F.col("__note") == F.col("block"), "legend").otherwise("data")).rows.drop("__note")
