"""Intake by steps, logs of edits and timetable columns on odd input."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from markbook.operators import changes
from markbook.plans import timetable
from markbook.sources import intake, sheetreader


def test_files_are_taken_in_once(spark, tmp_path):
    folder, manifest = tmp_path / "in", str(tmp_path / "seen")
    (folder / "deep").mkdir(parents=True)
    (folder / "a.txt").write_text("1")
    (folder / "deep" / "b.txt").write_text("2")
    (folder / "c.csv").write_text("no")
    names = lambda s: [p.rsplit("/", 1)[-1] for p in s.paths()]
    first = intake.step(spark, str(folder), manifest, "*.txt")
    assert sorted(names(first)) == ["a.txt", "b.txt"] and first.n == 2
    again = intake.step(spark, str(folder), manifest, "*.txt")
    first.record()
    again.record()  # the same step, done twice
    assert intake.recorded(spark, manifest).count() == 2
    assert intake.step(spark, str(folder), manifest, "*.txt").n == 0
    (folder / "a.txt").write_text("longer")
    (folder / "d.txt").write_text("4")
    second = intake.step(spark, str(folder), manifest, "*.txt")
    assert sorted(names(second)) == ["a.txt", "d.txt"]
    second.record()
    assert intake.step(spark, str(folder), manifest, "*.txt").n == 0


def brute_intervals(edits):
    out, by = [], {}
    for k, v, at, seq in edits:
        if k is not None and at is not None:
            by.setdefault(k, {}).setdefault(at, []).append((seq, v if v and v.strip() else None))
    for k, times in by.items():
        now = None
        for at in sorted(times):
            v = max(times[at], key=lambda x: x[0])[1]
            if v == now:
                continue
            if now is not None:
                out[-1] = (*out[-1][:3], at)
            if v is not None:
                out.append((k, v, at, None))
            now = v
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_edits_against_brute_force(spark, seed):
    rng, start = random.Random(seed), datetime.datetime(2026, 1, 1)
    edits = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["a", "b", " ", None]), start + datetime.timedelta(minutes=rng.randrange(120)), i) for i in range(400)]
    df = spark.createDataFrame(edits, "k long, v string, at timestamp, seq int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = changes.compacted(df, "k", "v", "at", "seq")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_intervals(edits)
        when = start + datetime.timedelta(minutes=60)
        want = sorted((k, v) for k, v, a, b in brute_intervals(edits) if a <= when and (b is None or b > when))
        assert sorted(tuple(r) for r in changes.as_of(got, F.lit(when)).collect()) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert changes.compacted(df.limit(0), "k", "v", "at", "seq").count() == 0


def test_overrides(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k long, name string")
    mapping = spark.createDataFrame([(1, "one")], "key long, value string")
    got = changes.overridden(df, "k", mapping, "name", F.col("name"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([(1, "one"), (2, "y"), (None, "z")], key=repr)


def test_columns_are_bounded(spark):
    df = spark.createDataFrame([(str(i % 7),) for i in range(20)] + [(None,)], "s string")
    assert timetable.discovered(df, "s") == list("0123456")
    with pytest.raises(ValueError, match="more than 3"):
        timetable.discovered(df, "s", 3)


def test_timetable_workbook_of_all_sheets(spark, tmp_path):
    data = [(datetime.date(2026, 1, d), "10:00 AM", s * 3600, f"S{d}", "1", f"P{s}", "2025", s) for d in (5, 6) for s in (1, 2)]
    scheduled = spark.createDataFrame(data, "day date, time string, secs long, school string, session string, subject string, year string, students long")
    missing = spark.createDataFrame([("m1", "Yes")], "module string, incomplete string")
    timetable.timetable_workbook(str(tmp_path), scheduled, missing)
    rows = sheetreader.read(spark, str(tmp_path / "Timetable.xlsx"), every_sheet=True, blank="").rows
    got = {}
    for r in rows.orderBy("sheet_no", "_row_no").collect():
        got.setdefault(r.sheet, []).append(r.cells)
    assert list(got) == ["Schedule", "Timetable", "Analysis", "Incomplete Data"]
    assert [r[4] for r in got["Schedule"]] == ["subject", "P2", "P1", "P2", "P1"]
    assert got["Timetable"] == [["day", "time", "S5 / 1", "S6 / 1"], ["2026-01-05", "10:00 AM", "P2 (2025 | 2) / P1 (2025 | 1)", "--"], ["2026-01-06", "10:00 AM", "--", "P2 (2025 | 2) / P1 (2025 | 1)"]]
    assert got["Analysis"][1:] == [["2026-01-05", "10:00 AM", "3", "0", "3"], ["2026-01-06", "10:00 AM", "0", "3", "3"]]
    assert got["Incomplete Data"] == [["module", "incomplete"], ["m1", "Yes"]]
