"""Operators on literal frames: order, ties, nulls and policies."""

import random

import pytest
from pyspark.sql import functions as F

from markbook.operators import aggregates as A
from markbook.operators import filters as P
from markbook.operators import graph as G
from markbook.operators import joins as J
from markbook.operators import reshape as R
from markbook.operators import schema as C
from markbook.operators import sets as U
from markbook.operators import windows as W


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_header_policies():
    cols = ["Roll No", "roll_no", "Student  Name", "PRN (2024)"]
    assert C.find(cols, ["RollNo"]) == "Roll No"
    assert C.find(cols, ["RollNo"], on_duplicate="last") == "roll_no"
    assert C.find(cols, ["prn"], prefix=True) == "PRN (2024)"
    assert C.find(cols, ["student name"], fold="words") == "Student  Name"
    assert C.find(cols, ["nothing"]) is None
    assert C.find_containing(cols, [["student", "id"], ["student"]]) == "Student  Name"
    assert C.find_containing(cols, [["x"]], fallback=0) == "Roll No"
    assert C.header_maximum(["Q1 (10)", "Q2 (5)", "Name"]) == 15
    assert C.unique_names(["a", "A", "b"]) == ["a", "A_2", "b"]
    assert C.section_order(["x", "Sem II C", "Sub2 a", "id", "Sub1 a", "Sem I C", "tot"], ["id"], ["tot"], []) == ["id", "Sub1 a", "Sub2 a", "Sem I C", "Sem II C", "tot", "x"]


def test_bind_raises_for_required(spark):
    df = spark.createDataFrame([("1",)], "`Student Number` string")
    assert C.bind(df, {"student": ("Student Number",), "x": ()}).columns == ["student", "x"]
    with pytest.raises(C.MissingColumns, match="x"):
        C.bind(df, {"x": ()}, required=("x",))


def test_casing_twins_are_coalesced(spark):
    a = spark.createDataFrame([("1", None)], "`Roll No` string, Name string")
    b = spark.createDataFrame([(None, "2")], "`roll no` string, `ROLL NO ` string")
    got = U.union_all({"a": a, "b": b})
    assert got.columns == ["Roll No", "Name", "Source File"]
    assert rows(got) == [("1", "", "a"), ("2", "", "b")]
    with pytest.raises(ValueError):
        U.union_all({"a": a.select("Name"), "b": b}, "intersection")


def test_columns(spark):
    df = spark.createDataFrame([("1", "", None)], "a string, b string, c string")
    assert C.without_blank_columns(df).columns == ["a"]
    assert C.move_after(df, ["c"], "a").columns == ["a", "c", "b"]
    assert rows(C.conform(df, ["b", "z"])) == [("", "")]
    assert C.present(df, ["z", "b"]).columns == ["b"]


def test_filters_are_null_safe(spark):
    df = spark.createDataFrame([("1", "Count : 3"), (None, None), ("2", "x"), ("q", "y"), ("", " ")], "k string, v string")
    assert P.drop_empty(df).count() == 3
    assert P.drop_matching(df).count() == 4
    assert rows(P.numeric_key(df, "k").select("k")) == [("1",), ("2",)]
    assert P.search(df, "COUNT").count() == 1 and P.search_plain(df, "2 X").count() == 1
    assert P.choose(df, {"k": "All", "v": "x"}).count() == 1
    assert rows(P.cascade(df, {"k": "1", "v": "All"}).where("field = 'k'")) == [("k", ""), ("k", "1"), ("k", "2"), ("k", "q")]


@pytest.mark.parametrize(
    ("programme", "entry", "gpas", "ok"),
    [
        ("B.Com", "", {1: "8", 2: "7", 5: "9", 6: "9"}, True), ("B.Com", "", {1: "8", 2: "", 5: "9", 6: "9"}, False), ("B.Com", "Lateral Admission", {3: "", 4: "", 5: "9", 6: "8"}, True),
        ("B.Com", "Lateral Admission", {3: "7", 4: "", 5: "9", 6: "8"}, False), ("M.Com", "Lateral Admission", {3: "7", 4: "8", 5: "", 6: ""}, True), ("M.Com", "lateral admission", {3: "7", 4: "nan", 5: "", 6: ""}, False),
    ],
)
def test_gpa_rule(spark, programme, entry, gpas, ok):
    df = spark.createDataFrame([(programme, entry)], "p string, e string")
    assert df.select(P.gpa_complete(F.col("p"), F.col("e"), {k: F.lit(v) for k, v in gpas.items()}).alias("x")).first().x is ok


def test_lookup_policies(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    side = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, None, 3)], "k int, v string, n int")
    assert rows(J.lookup(left, side, ["k"], {"v": "x"}, ["n"], "first", "-")) == [(1, "a"), (2, "-"), (None, "-")]
    assert rows(J.lookup(left, side.where("n < 3"), ["k"], {"v": "x"}, ["n"], "last")) == [(1, "b"), (2, None), (None, None)]
    assert rows(J.flagged_lookup(left, side, ["k"], {"v": "x"}, ["n"])) == [(1, "a", "No"), (2, None, "Yes"), (None, None, "Yes")]


def test_windows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b"), (5, "a")], "i int, v string")
    assert [r[2] for r in rows(W.runs(df, "v", ["i"]))] and sorted(r.n for r in W.runs(df, "v", ["i"]).collect()) == [1, 1, 1, 2]
    assert rows(W.distinct_rank(df, "v", "r").select("i", "r")) == [(1, 1), (2, 1), (3, None), (4, 2), (5, 1)]
    assert rows(W.duplicate_flag(df.union(df.where("v is null")), ["v"]).select("v", "is_duplicate").distinct()) == [("a", True), ("b", False), (None, True)]
    first, last = W.deduplicate(df, ["v"], [F.asc("i")]), W.deduplicate(df, ["v"], [F.desc("i")])
    assert rows(first.select("i")) == [(1,), (3,), (4,)] and rows(last.select("i")) == [(3,), (4,), (5,)]
    assert first.count() + df.join(first, "i", "left_anti").count() == df.count()


def test_blocks_need_their_end(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate("xSaEbScEaSd")], "d int, i int, t string")
    got = W.blocks(df, F.col("t") == "S", F.col("t") == "E", ["i"], ["d"])
    assert "".join(r.t for r in got.orderBy("i").collect()) == "SaEScE"
    assert "".join(r.t for r in W.segments(df, F.col("t") == "S", ["i"], ["d"]).orderBy("i").collect()) == "SaEbScEaSd"


def test_totals_and_shares(spark):
    df = spark.createDataFrame([("x", 1, 1), ("x", 1, 0), (None, 2, 0), ("", 3, 3)], "k string, a int, b int")
    assert rows(A.with_total(df, "k", {"n": F.count("*")})) == [("TOTAL", 4), ("[UNMATCHED]", 2), ("x", 2)]
    assert rows(A.completion(df.where("k = 'x'"), ["k"], F.col("a"), F.col("b"))) == [("x", 2, 1, 50.0)]
    assert A.completion(df.limit(0), [], F.col("a"), F.col("b")).first()[:] == (0, 0, 0.0)
    assert A.rule_of_share(df, [], F.col("b") > 0).first().eligible is False


def test_shapes(spark):
    df = spark.createDataFrame([("TH a | b | | ",), ("",), (None,)], "l string")
    assert [r.c for r in df.select(R.pipe_cells(F.col("l"), "TH").alias("c")).collect()] == [["a", "b", ""], [], []]
    cells = spark.createDataFrame([([(None, 1), (4, None), (None, None)],)], "c array<struct<index:int,span:int>>")
    assert cells.select(R.cell_positions(F.col("c")).alias("p")).first().p == [0, 3, 4]


@pytest.mark.parametrize("seed", range(4))
def test_slots_are_proper(spark, seed):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(24), 2))) for _ in range(30)})
    e = spark.createDataFrame(edges, "a int, b int")
    slots = G.assign_slots(spark.createDataFrame([(i,) for i in range(24)], "node int"), e)
    got = dict(tuple(r) for r in slots.collect())
    assert set(got) == set(range(24)) and all(got[a] != got[b] for a, b in edges)
    assert min(got.values()) == 1 and set(got.values()) == set(range(1, max(got.values()) + 1))
    assert G.violations(slots, e).count() == 0


def test_triangle_with_pendant_needs_three():
    assert set(G.color([1, 2, 3, 4], [(1, 2), (2, 3), (1, 3), (3, 4)]).values()) == {1, 2, 3}


def test_clusters_never_share_members():
    names = ["BUSINESS LAW", "BUSINESS LAWS", "STATISTICS"]
    apart = {"BUSINESS LAW": {1}, "BUSINESS LAWS": {2}, "STATISTICS": {3}}
    assert G.greedy_clusters(names, apart, 0.9) == {"BUSINESS LAW": "BUSINESS LAW", "BUSINESS LAWS": "BUSINESS LAW", "STATISTICS": "STATISTICS"}
    assert G.greedy_clusters(names, apart | {"BUSINESS LAWS": {1}}, 0.9)["BUSINESS LAWS"] == "BUSINESS LAWS"
    assert G.greedy_clusters(names, apart, 1.0) == {n: n for n in names}


def test_waterfill():
    got = G.waterfill({"a": 1, "b": 1, "c": 8}, {"a": 20, "b": 5, "c": 5}, 100)
    assert got["a"] == 20 and abs(sum(got.values()) - 100) < 1e-9 and got["c"] > got["b"] >= 5
    assert abs(sum(G.waterfill({"a": 1, "b": 1}, {"a": 80, "b": 80}, 100).values()) - 100) < 1e-9


def test_pairs_within_partitions_grow_with_the_rows(spark, monkeypatch):
    from markbook.operators import joins

    monkeypatch.setattr(joins, "ROWS_EACH", 100, raising=False)
    rows = [(i // 4, i % 97) for i in range(2000)] + [(None, 1), (1, None), (0, 0)]
    df = spark.createDataFrame(rows, "g int, n int")
    pairs = joins.pairs_within(df, "g", "n")
    groups = {}
    for g, n in rows:
        if g is not None and n is not None:
            groups.setdefault(g, set()).add(n)
    assert sorted(map(tuple, pairs.collect())) == sorted({(a, b) for x in groups.values() for a in x for b in x if a < b})
    assert "hashpartitioning(g" in (plan := pairs._jdf.queryExecution().toString()) and "21), REPARTITION_BY_NUM" in plan
